"""Panel analytics on Spark: long-format bar panels in, factor, label, metric and blend frames out.

Every operator is a function ``DataFrame -> DataFrame``. The building blocks are in ``plans``:
``ordinal`` numbers rows without sorting a whole group in one task, ``chunks`` runs windows over
bounded pieces of a symbol, ``xsec`` computes group statistics and ranks, ``moments`` keeps the
additive statistics every fit and grid search starts from.
"""

from odd_rows import ODD

from barwright.llm import license_texts, licenses

MIT = license_texts.TEXTS[0][1]


def test_variants_of_a_licence(docs_of):
    wild = "MIT  LICENSE\n\nCopyright (c) 2020-2024 Someone, Inc.\n© 2019 Another\n\n" + MIT.replace("sublicense", "sub-license").replace(
        '"', "“").replace(". ", ".\n   ").upper().replace("HTTP", "https")
    rows = [(1, MIT), (2, wild), (3, MIT + " and more"), (4, MIT.replace("free of charge", "at a charge")), (5, "a\nReleased  under the MIT licence!\nb"),
            (6, "released under the mit license"), (7, "We hold all rights reserved. Yes."), (8, "x\nAll rights reserved.\nLicensed under CC BY-NC 4.0.\nAll rights reserved")]
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(docs_of(rows)).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, ""), 5: (None, "MIT"), 6: ("MIT", "MIT"), 7: (None, ""),
                   8: (None, "CC-BY-NC-4.0,all-rights-reserved")}


def test_copyright_in_a_sentence_stays(docs_of):
    got = licenses.scan(docs_of([(1, "copyright notice and this"), (2, "and this"), (3, "Copyright 2020 me\nand this")])).collect()
    digest = {r.doc_id: r.digest for r in got}
    assert digest[1] != digest[2] == digest[3]


def test_odd_rows(docs_of):
    got = licenses.scan(docs_of(ODD)).collect()
    assert len(got) == len(ODD) and all(r.license is None and r.notices == "" for r in got)
    assert len({r.digest for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert licenses.scan(docs_of(ODD).limit(0)).collect() == []

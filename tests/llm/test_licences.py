import pytest

from cuelake.llm import licences
from cuelake.llm.licence_texts import KNOWN
from tests.llm.tables import cases, documents, empty

MIT = next(text for name, text in KNOWN if name == "MIT" and len(text) > 500)


def found(df):
    return sorted(((r.doc_id, r.text_licence, r.line_licences) for r in df.collect()), key=repr)


def test_each_known_text_is_found(spark):
    rows = [(k, text, None) for k, (_, text) in enumerate(KNOWN)]
    got = {r.doc_id: r.text_licence for r in licences.find_licences(documents(spark, rows)).collect()}
    assert got == {k: name for k, (name, _) in enumerate(KNOWN)}


@pytest.mark.parametrize("text", [
    MIT.upper(), "Copyright (c) 2019 Someone\n(C) 2020 Other\n\n" + MIT, MIT.replace("\n", "  \n * "), MIT.replace("NONINFRINGEMENT", "NON-INFRINGEMENT"),
    MIT.replace('"', "“"),
])
def test_variants_of_one_licence(spark, text):
    assert licences.find_licences(documents(spark, [(1, text, None)])).first().text_licence == "MIT"


def test_lines_and_near_misses(spark):
    rows = [
        (1, "prose\n  released UNDER the MIT licence!\nprose\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", None),
        (2, "Released under the MIT License, mostly.", None), (3, MIT + " but not on Sundays", None),
        (4, "Licensed under the Apache License, Version 2.0.", None),
    ]
    assert found(licences.find_licences(documents(spark, rows))) == sorted(
        [(1, None, "CC-BY-NC-4.0,MIT"), (2, None, None), (3, None, None), (4, "Apache-2.0", "Apache-2.0")], key=repr
    )


def test_the_two_forms_agree(spark):
    texts = [MIT, "Copyright 2020 x\nCopyright notice", "A-B_c  Licences' organisation", "(c) 1999", "© 2001\nx", "copyright © 2001 y\nz"]
    df = documents(spark, [(k, t, None) for k, t in enumerate(texts)])
    got = {r.doc_id: r.form for r in df.select("doc_id", licences.canonical(df.text).alias("form")).collect()}
    assert got == {k: licences.canonical_text(t) for k, t in enumerate(texts)}


def test_native_and_cases(spark):
    docs = cases(spark)
    out = licences.find_licences(docs)
    assert found(out) == sorted([(r.doc_id, None, None) for r in docs.collect()], key=repr)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    assert licences.find_licences(empty(spark)).count() == 0


def body(name):
    return next(text for known, text in KNOWN if known == name and len(text) > 500)


@pytest.mark.parametrize("head", [
    "MIT License\n\nCopyright (c) 2020 X\n\n", "The MIT License (MIT)\n\nCopyright (c) Microsoft Corporation. All rights reserved.\n\n",
    "Copyright Some Body, 2019\nAll rights reserved.\n\n", "Copyright The Project Authors.\n", "LICENSE\n=======\n© Some Body\n\n",
])
def test_licence_files_with_headings(spark, head):
    rows = [(1, head + body("MIT"), None)]
    assert licences.find_licences(documents(spark, rows)).first().text_licence == "MIT"


def test_standard_texts(spark):
    files = {
        "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + body("BSD-2-Clause"),
        "BSD-3-Clause": "Copyright 2020 X\n" + body("BSD-3-Clause").replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "),
        "ISC": "ISC License\n\nCopyright (c) 2020 X\n\n" + body("ISC"),
        "Apache-2.0": body("Apache-2.0"), "GPL-2.0": body("GPL-2.0"), "GPL-3.0": body("GPL-3.0"), "LGPL-2.1": body("LGPL-2.1"),
        "LGPL-3.0": body("LGPL-3.0"), "MPL-2.0": body("MPL-2.0"), "CC0-1.0": body("CC0-1.0"), "Unlicense": body("Unlicense"),
    }
    files["Apache-2.0"] = next(t for n, t in KNOWN if n == "Apache-2.0" and len(t) > 9000).split("   APPENDIX:")[0]
    rows = [(k, text, None) for k, text in enumerate(files.values())]
    got = {r.doc_id: r.text_licence for r in licences.find_licences(documents(spark, rows)).collect()}
    assert got == dict(enumerate(files))


def test_sentences_that_begin_with_the_word_stay():
    for line in ("copyright notice and this permission notice appear in all copies.", "copyright holders be liable", "(c) you must retain"):
        assert licences.canonical_text(line) == " ".join(line.rstrip(".").replace("(c)", "c").split())
    for line in ("Copyright (c) Microsoft Corporation.", "Copyright X, 2019-2021", "All rights reserved.", "# (C) 2020 X", "Copyright Google LLC"):
        assert licences.canonical_text(line) == ""


def test_headings_have_one_form_in_both_dialects(spark):
    import duckdb

    lines = ["Copyright (c) Microsoft Corporation.", "copyright notice", "All rights reserved.", "copyright x_inc", "(c) you must retain",
             "Copyright X 1 Inc.", "_copyright x, 2020", "© X", "copyright 12020", "x copyright 2020"]
    df = documents(spark, [(k, t, None) for k, t in enumerate(lines)])
    native = {r.doc_id: r.form for r in df.select("doc_id", licences.canonical(df.text).alias("form")).collect()}
    assert native == {k: licences.canonical_text(t) for k, t in enumerate(lines)}
    for k, line in enumerate(lines):
        out = duckdb.execute(
            f"SELECT trim(regexp_replace(regexp_replace(lower(?), '{licences.COPYRIGHT_LINE}', ' ', 'g'), '{licences.MARKS}', ' ', 'g'))", [line]
        ).fetchone()[0]
        assert out == native[k]

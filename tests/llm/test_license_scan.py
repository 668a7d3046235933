import pathlib

import pytest

from tessera.llm.license_scan import scan
from tessera.llm.license_texts import LICENSES


def test_whole_texts_and_notices(spark, docs):
    mit = next(t for n, _, t in LICENSES if n == "MIT")
    rows = [
        (1, mit),
        (2, "The MIT License (MIT)\n\nCopyright (c) 2020 Some One\n\n" + mit.upper().replace(" ", "  \n")),
        (3, mit + " and more"),
        (4, "Words.\nReleased under the MIT License.\nMore words.\nlicensed under cc by-nc 4.0"),
        (5, "Licensed under the Apache Licence, Version 2.0."),
        (6, None),
        (7, ""),
        (7, ""),
        (None, mit),
    ]
    got = sorted(((r.doc_id or 0, r.license, r.notices, r.digest is None) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, "MIT", [], False), (2, "MIT", [], False), (3, None, [], False), (4, None, ["CC-BY-NC-4.0", "MIT"], False), (5, None, ["Apache-2.0"], False), (6, None, [], True), (7, None, [], False), (7, None, [], False), (0, "MIT", [], False)], key=repr)


def test_columns_stay_and_plans_hold_no_python(docs):
    out = scan(docs)
    assert out.columns == [*docs.columns, "digest", "license", "notices"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert out.count() == docs.count()


def test_empty(none):
    assert scan(none).collect() == []


def test_copyright_lines(spark):
    mit = next(t for n, _, t in LICENSES if n == "MIT")
    heads = ["Copyright (c) Facebook, Inc. and its affiliates.", "Copyright Jane Doe 2020", "Copyright (c) Jane Doe, 2020", "Portions Copyright 2001 X", "© 2019 Y", "(c) 2018 Z", "Copyright © Somebody\nAll rights reserved."]
    rows = [(i, f"MIT License\n\n{h}\n\n{mit}") for i, h in enumerate(heads)] + [(99, f"MIT License\n\nCopyright is a word.\n\n{mit}")]
    got = {r.doc_id: r.license for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(len(heads)), "MIT") | {99: None}


def test_full_texts(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not folder.exists():
        pytest.skip("no licence texts on this machine")
    rows = [(n, " ".join((folder / f).read_text().upper().split(" ")).replace("\n", " \n\t")) for f, n in names.items()]
    got = scan(spark.createDataFrame(rows, "name string, text string")).collect()
    assert [r.license for r in got] == [r.name for r in got] and len(got) == 7


def test_spellings_read_alike(spark):
    rows = [(0, "The licence is recognised and authorised, favourable to the copyright owner."), (1, "The license is recognized and authorized; favorable to the Copyright-Holder!")]
    assert len({r.digest for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}) == 1

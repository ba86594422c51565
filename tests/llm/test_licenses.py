import textwrap

import duckdb

from tessera.llm import licenses


def test_inheritance_and_names(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/code.py", "no statement"), (3, "a/b/COPYING.txt", "Licensed under the Apache License, Version 2.0."),
        (4, "a/x.txt", None), (5, "z/y.txt", "words"), (6, "a/b/c/own.txt", ("filler words here. " * 50) + "Licensed under CC BY-NC 4.0. more words follow. " * 2),
        (7, "top.txt", ""), (8, None, "x"), (9, "m/only.txt", "All rights reserved."), (10, "m/n/o.txt", "license to do things nobody knows"), (11, "a/b/c/code.py", "no statement"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "row long, path string, text string, license int")
    got = {r.row: (r.own_license, r.license_file, r.license, r.inherited_from) for r in licenses.scan(df).collect()}
    assert got == {
        1: ("MIT", True, "MIT", None), 2: (None, False, "Apache-2.0", "a/b"), 3: ("Apache-2.0", True, "Apache-2.0", None), 4: (None, False, "MIT", "a"),
        5: (None, False, None, None), 6: ("CC-BY-NC-4.0", False, "CC-BY-NC-4.0", None), 7: (None, False, None, None), 8: (None, False, None, None),
        9: ("Proprietary", True, "Proprietary", None), 10: (None, False, "Proprietary", "m"), 11: (None, False, "Apache-2.0", "a/b"),
    }
    assert licenses.scan(df.limit(0)).count() == 0


def test_each_template_finds_itself(spark):
    every = [*licenses.STATEMENTS, *licenses.FULL_TEXTS]
    rows = [(k, f"d{k}/f", "\n".join(f" * {line}" for line in textwrap.wrap(text, 60))) for k, (_, text) in enumerate(every)]
    got = {r.row: (r.own_license, r.own_score) for r in licenses.scan(spark.createDataFrame(rows, "row long, path string, text string")).collect()}
    assert all(got[k][1] == 1.0 for k in range(len(licenses.STATEMENTS), len(every)))
    same = {k: {n for n, t in every if sorted(licenses.terms_of(t)) == sorted(licenses.terms_of(every[k][1]))} for k in got}
    assert all(got[k][0] in same[k] and got[k][1] >= licenses.LEAST for k in got if every[k][0] != licenses.GENERIC), {k: (every[k], got[k]) for k in got if got[k][0] not in same[k]}


def test_headers_and_files_by_their_text(spark):
    """Wrapped headers over code, a licence's body without any notice, specific licences
    before the generic one."""
    full = dict(licenses.FULL_TEXTS)
    code = "\n\nimport os\n\ndef main(values):\n    return sum(values) + os.getpid()\n" * 5
    comment = lambda text: "\n".join(f"# {line}" for line in textwrap.wrap(text, 70))
    body = full["MIT"][full["MIT"].index("THE SOFTWARE IS PROVIDED") :]
    rows = [
        (1, "a/x.py", comment("Copyright (c) 2019 Some One. All rights reserved. " + full["BSD-3-Clause"]) + code), (2, "a/y.py", comment(full["BSD-2-Clause"]) + code),
        (3, "b/x.py", comment(full["Apache-2.0"]) + code), (4, "c/anything", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + textwrap.fill(full["MIT"], 75)), (5, "c/d/e.py", "x = 1"),
        (6, "e/x.py", comment(full["LGPL-2.1"]) + code), (7, "f/x.py", comment(full["ISC"]) + code), (8, "g/x.py", body), (9, "h/x", "Licensed under CC BY-NC-SA 4.0."),
    ]
    got = {r.row: (r.own_license, r.license_file, r.license) for r in licenses.scan(spark.createDataFrame(rows, "row long, path string, text string")).collect()}
    assert got == {
        1: ("BSD-3-Clause", False, "BSD-3-Clause"), 2: ("BSD-2-Clause", False, "BSD-2-Clause"), 3: ("Apache-2.0", False, "Apache-2.0"), 4: ("MIT", True, "MIT"), 5: (None, False, "MIT"),
        6: ("LGPL-2.1", False, "LGPL-2.1"), 7: ("ISC", False, "ISC"), 8: ("MIT", True, "MIT"), 9: ("CC-BY-NC-SA-4.0", True, "CC-BY-NC-SA-4.0"),
    }


def test_oracle(spark, tmp_path):
    texts = ["Licensed under the MIT license.", "plain", None, "x! All rights reserved. y", "Copyright 2020 Someone. All rights reserved.", "This is released under version 3 of the GNU General Public License, see there", "Éa. CC0 1.0"] * 3
    texts += [dict(licenses.FULL_TEXTS)["ISC"] + "\n\nwords\n \n\nand more words of no licence", "a\n\nLicensed under the Apache License,\nVersion 2.0."]
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}" + "/sub" * (i % 5 == 0), 0) for i, t in enumerate(texts)]
    rows += [(None, "All rights reserved.", "en", "s1", 0), (None, "no licence", "en", "s1", 0), (3, "Released under the MIT License.", "xx", "s9", 0), (None, None, None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    cols = ["doc_id", "path", "n_statements", "own_license", "own_score", "license_file", "license", "inherited_from"]
    got = sorted(map(tuple, licenses.op6_license_scan(spark, str(tmp_path)).select(cols).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(f"select {', '.join(cols)} from ({licenses.ORACLE_SQL})").fetchall(), key=str) and len(got) == len(rows)

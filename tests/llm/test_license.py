import math

import duckdb
import pytest

from assaylake.llm import license_scan as li
from assaylake.llm.queries import ORACLE_SQL, op3_license_scan

from .helpers import documents, simple_words

BREAKS = str.maketrans(dict.fromkeys("\n\r\x0b\x0c\x85\u2028\u2029", "\n"))


def plain(rows):
    sets = li.template_sets(li.TEMPLATES)
    out = []
    for doc, text in rows:
        lines, more = [simple_words(x) for x in (text or "").replace("\r\n", "\n").translate(BREAKS).split("\n")], []
        paragraphs = [[]]
        for line in lines:
            paragraphs = [*paragraphs, []] if not line else [*paragraphs[:-1], paragraphs[-1] + line]
        for words in paragraphs:
            for label, t in sets:
                both = max((len(set(words[i : i + li.WIDE * len(t)]) & set(t)) for i in range(len(words))), default=0)
                if both >= math.ceil(0.9 * len(t) - 1e-9):
                    more.append((label, both / len(t)))
        w = simple_words(text)
        base = []
        for label, phrase in li.PHRASES.items():
            p = phrase.split()
            base += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        places = [i for i, _ in base]
        labels = {x for _, x in base}
        score = 1.0 if base else max((s for _, s in more), default=0.0)
        out.append((doc, len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x for x, _ in more})), round(score, 9)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((*tuple(r)[:7], round(r.score, 9)) for r in df.collect()), key=repr)


def test_cases(spark):
    given = [
        (1, "x Released under the MIT License. y\nunder THE mit-license; cc-by/nc"),
        (2, "Apache License, Version 2"),
        (3, "apache license version 20"),
        (4, None),
        (5, ""),
        (6, "!!! ..."),
        (7, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions"),
        (8, "Redistribution and use in source\nand binary forms, with or without modification, are permitted"),
        (7, "nothing of the kind"),
        (20, "Permission is hereby granted, free of charge, to any person\r\nobtaining a copy of this software and associated documentation\nfiles (the Software), to deal in the Software without restriction"),
        (21, "Permission is hereby granted, free of charge, to any person\n\nobtaining a copy of this software and associated documentation\nfiles (the Software), to deal in the Software without restriction"),
        (22, "x\n# Redistribution and use in source and binary forms,\n# with or without modification, are permitted provided\n# that the following conditions are met:\n\ny"),
        (23, "Released\nunder\nthe\nMIT\nnotes License"),
        (9, "word " * 20_000 + "cc by nc " + "word " * 5),
        (10, "cc by nc cc by nc"),
        (10, "under the mit license"),
        (None, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        (11, "This work is licensed under the GNU General Public License, version 3. é"),
        (12, "under the mİt license \u212a"),
    ]
    assert rows(li.scan_licenses(documents(spark, given))) == plain(given)
    assert li.scan_licenses(documents(spark, [])).count() == 0


def test_any_wrapping(spark):
    """The MIT grant and a short notice at 1 to 12 words a line, as comments, with prose around."""
    grant = next(t for _, t in li.TEMPLATES if t.startswith("Permission is hereby granted, free of charge, to any person obtaining")).split()
    given = []
    for n in range(1, 13):
        wrapped = "\n".join("# " + " ".join(grant[i : i + n]) for i in range(0, len(grant), n))
        given += [(n, wrapped), (100 + n, f"Some words before it,\n{wrapped}\nand others after it.")]
    far = "released of old\n" + "word " * 30 + "under the sea, the MIT gave license"
    given += [(200, far), (201, "released\nunder\nthe\nMIT\nlicense"), (202, "released under\n\nthe good MIT license")]
    found = rows(li.scan_licenses(documents(spark, given)))
    assert found == plain(given)
    labels = {r[0]: r[6] for r in found}
    assert {labels[i] for i in (*range(1, 13), *range(101, 113), 201)} == {"mit"} and labels[200] == labels[202] == ""


def test_whole_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert any(w[2] for w in want)
    assert rows(li.scan_licenses(docs)) == want


@pytest.mark.parametrize("word", ["Python", "Arrow", "Pandas"])
def test_native(spark, tiny, word):
    plan = li.scan_licenses(spark.read.parquet(f"{tiny}/documents.parquet"))._jdf.queryExecution().toString()
    assert word not in plan


def test_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    df = op3_license_scan(spark, small)
    found = con.execute(ORACLE_SQL["op3_license_scan"])
    assert [c[0] for c in found.description] == df.columns
    want = found.fetchall()
    assert rows(df) == sorted(((*r[:7], round(r[7], 9)) for r in want), key=repr)

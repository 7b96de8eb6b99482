"""Bundles are read once for each table that is asked for."""

import hashlib
import io
import zipfile

import pytest

from assaylake.plans import QUERIES
from assaylake.sources import bundles


@pytest.mark.parametrize("name", ["q_bundle_documents", "q_bundle_files"])
def test_bundles_are_made_and_read_once(spark, tiny, name):
    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Exchange hashpartitioning(l_orderkey" not in plan


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_zips_as_zipfile_writes_them():
    members = [("exam.json", "{}"), ("assets/f1.jpg", "part 1é" * 99), ("x/assets/f2.PNG", ""), ("assets/f1.jpg", "again")]
    for case in (members, [], members[:1] + [("é.png", "x")], members + [("folder/", "")]):
        told = io.BytesIO()
        with zipfile.ZipFile(told, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
            for name, text in case:
                z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
        assert bundles._zip(case) == told.getvalue()


def test_damaged_members(spark):
    """A picture whose bytes don't check has no digest, a damaged document is a broken zip, and neither ends a job."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    whole = bundles._zip([("exam.json", "{}"), ("assets/a.png", "a" * 400), ("assets/b.png", "bcd" * 9)])
    at = whole.index(b"assets/a.png") + len("assets/a.png")
    picture = whole[:at] + b"\xff" * 4 + whole[at + 4 :]
    at = whole.index(b"exam.json") + len("exam.json")
    document = whole[:at] + b"\xff" * 4 + whole[at + 4 :]
    files = [("z/good.zip", whole), ("z/picture.ZIP", picture), ("z/document.zip", document), ("z/text.json", b"\xff{}"), (None, whole), ("r/assets/in.zip", whole)]
    docs, assets = bundles.bundles(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary"))
    assert {tuple(r) for r in docs.collect()} == {("good", "{}", None), ("picture", "{}", None), ("document", None, bundles.BROKEN_ZIP), ("text", None, bundles.BROKEN_JSON), ("in", "{}", None), ("r", None, bundles.NOT_FOUND)}
    a, b = (400, sha(b"a" * 400)), (27, sha(b"bcd" * 9))
    assert {tuple(r) for r in assets.collect()} == {*(("good", r, *x) for r, x in (("assets/a.png", a), ("assets/b.png", b))), *(("in", r, *x) for r, x in (("assets/a.png", a), ("assets/b.png", b))), ("picture", "assets/a.png", None, None), ("picture", "assets/b.png", *b), ("r", "assets/in.zip", len(whole), sha(whole))}

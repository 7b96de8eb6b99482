"""Bundles of every kind from a folder, and repairs on hand-made tables."""

import hashlib
import io
import random
import re
import zipfile

from assaylake.operators import cleanup, documents, profiles, repair
from assaylake.sources import bundles, exams


def test_folder_of_bundles(spark, tmp_path):
    def zipped(name, members):
        told = io.BytesIO()
        with zipfile.ZipFile(told, "w") as z:
            for n, data in members.items():
                z.writestr(n, data)
        (tmp_path / name).write_bytes(told.getvalue())
        return told.getvalue()

    whole = zipped("top.zip", {"exam.json": '{"a": 1}', "assets/x.png": b"12", "y/assets/z.GIF": b"345", "notes.txt": b"6"})
    zipped("below.ZIP", {"b/exam.json": '{"b": 1}', "a/exam.json": '{"c": 1}'})
    zipped("none.zip", {"other.json": "{}"})
    zipped("bad.zip", {"exam.json": "{no"})
    (tmp_path / "cut.zip").write_bytes(whole[:40])
    for name, data in {"dir/exam.json": '{"d": 1}', "dir/assets/p.png": "abc", "dir/assets/sub/q.txt": "q", "bare.json": '{"e": 1}', "bare/assets/r.png": "r", "lost/assets/s.png": "s", "list/exam.json": "[1]"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(data)
    docs, files = bundles.read_bundles(spark, str(tmp_path))
    assert {tuple(r) for r in docs.collect()} == {
        ("top", '{"a": 1}', None), ("below", '{"c": 1}', None), ("none", None, bundles.NOT_FOUND), ("bad", None, bundles.BROKEN_JSON), ("cut", None, bundles.BROKEN_ZIP),
        ("dir", '{"d": 1}', None), ("bare", '{"e": 1}', None), ("lost", None, bundles.NOT_FOUND), ("list", None, bundles.BROKEN_JSON),
    }
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert {tuple(r) for r in files.collect()} == {
        ("top", "assets/x.png", 2, sha(b"12")), ("top", "assets/z.GIF", 3, sha(b"345")), ("dir", "assets/p.png", 3, sha(b"abc")), ("dir", "assets/sub/q.txt", 1, sha(b"q")), ("bare", "assets/r.png", 1, sha(b"r")), ("lost", "assets/s.png", 1, sha(b"s")),
    }
    assert {r.root for r in bundles.load_failures(docs).collect()} == {"none", "bad", "cut", "lost", "list"}


def test_contents(spark):
    """Null and empty contents are broken, not errors; a root may come up twice."""
    files = spark.createDataFrame([("a/x.zip", None), ("b/x.zip", bytearray(b"")), ("c/y.json", None)], "path string, content binary")
    docs, assets = bundles.bundles(files)
    assert sorted((r.root, r.error) for r in docs.collect()) == [("x", bundles.BROKEN_ZIP)] * 2 + [("y", bundles.BROKEN_JSON)] and assets.isEmpty()
    assert bundles.bundles(files.limit(0))[0].isEmpty()


def test_bare_groups(spark):
    q = spark.createDataFrame([("r", "q2", "2", "group", True, None), ("r", "q21", "2.1", "open_answer", False, "q2"), ("r", "q3", "3", "group", True, None), ("r", "q31", "3.1", "open_answer", False, "q3"), ("s", "q1", "1", "group", True, None)], "root string, question_id string, number string, type string, is_group boolean, parent string")
    pages = spark.createDataFrame([("r", "3.1. Sim"), ("s", "1. Sim")], "root string, text string")
    got = {(r.root, r.question_id): (r.type, r.is_group) for r in cleanup.found_subquestions(q, pages).collect()}
    assert got == {("r", "q2"): ("calculation", False), ("r", "q3"): ("group", True), ("r", "q31"): ("open_answer", False), ("s", "q1"): ("group", True)}


def test_better_text(spark):
    """Ties and no gain: the text stays unless the native one is long, clean and complete enough."""
    long = "palavras a mais para passar o limite de quarenta letras"
    rows = [("a??o e b??o", long, True), ("a??o e b??o", "curta", False), ("sem marcas", long, False), ("uma? só", long, False), ("a?? b", long + " ??", False), ("a?? b??", long + " ??", True), ("x?? " + "muitas palavras " * 200, long, False), (None, long, False), ("a??", None, False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "now string, native string")
    assert [r.x for r in df.select(repair.is_better(df.now, df.native).alias("x")).collect()] == [w for *_, w in rows]


def test_superseded_twice(spark):
    """A document that another question still refers to stays, without its media."""
    sources = spark.createDataFrame([("r", s) for s in ("grupo_i_texto_p2", "grupo_i_documento_1", "grupo_i_documento_2", None)], "root string, source_id string")
    refs = spark.createDataFrame([("r", 1, "grupo_i_texto_p2"), ("r", 1, "grupo_i_documento_1"), ("r", 1, "grupo_i_documento_2"), ("r", 2, "grupo_i_documento_2"), ("s", 1, "grupo_i_texto_p2"), ("s", 1, "grupo_i_documento_1")], "root string, ord long, source_id string")
    left, kept, media = documents.supersede(sources, refs, refs)
    assert sorted(map(str, (r.source_id for r in left.collect()))) == ["None", "grupo_i_documento_2", "grupo_i_texto_p2"]
    assert {tuple(r) for r in kept.select("root", "ord", "source_id").collect()} == {("r", 1, "grupo_i_texto_p2"), ("r", 2, "grupo_i_documento_2"), ("s", 1, "grupo_i_texto_p2"), ("s", 1, "grupo_i_documento_1")}
    assert {tuple(r) for r in media.select("root", "ord", "source_id").collect()} == {("r", 1, "grupo_i_texto_p2"), ("s", 1, "grupo_i_texto_p2"), ("s", 1, "grupo_i_documento_1")}


def test_document_numbers(spark):
    """Explicit labels win by page, pages without questions first; only a group's first unlabelled page is its document 1."""
    pages = spark.createDataFrame([("r", 2, "Documento 2"), ("r", 3, "nada"), ("r", 4, "1. diga, documento 1 e DOCUMENTO 02"), ("r", 5, "nada"), ("r", 6, None), ("r", 7, "Documento 1")], "root string, page long, text string")
    groups = spark.createDataFrame([("r", p, "grupo_i" if p < 5 else "grupo_ii") for p in range(2, 8)], "root string, page long, group_id string")
    asked = spark.createDataFrame([("r", 4)], "root string, page long")
    assert sorted(map(tuple, documents.labelled(pages, groups, asked).collect())) == [("r", "grupo_i", "1", 4), ("r", "grupo_i", "2", 2), ("r", "grupo_ii", "1", 5)]


def axis_free(text):
    """The same by the rules' words: every start of a stretch is tried in turn, without looking for runs first."""
    lines = text.split("\n")
    size = [len(x.strip()) for x in lines]
    out, at = [], 0
    while at < len(lines):
        end = next((k for k in range(at, len(lines)) if size[k] > 6), len(lines)) if 1 <= size[at] <= 5 else at
        figure = re.search(r"[Ff]igura\s*\d+", "\n".join(lines[max(0, at - 2) : end + 3]))
        torn = end - at >= 6 and max(size[at:end]) <= 3 and any(n > 8 for n in size[max(0, at - 3) : at]) and any(n > 8 for n in size[end : end + 3])
        if end - at >= 3 and (figure or torn):
            at = end
        else:
            out.append(lines[at])
            at += 1
    return "\n".join(out)


def test_axis_lines(spark):
    rng = random.Random(4)
    parts = ["", "a", "x2", "abc", "abcd", "abcde", "abcdef", "um texto corrido", "Figura 3", "Figura", "7", "  b  ", "médio 7"]
    texts = ["\n".join(rng.choices(parts, [3, 9, 9, 9, 2, 2, 1, 4, 1, 1, 3, 3, 2], k=rng.randint(1, 40))) for _ in range(400)] + [None, "", "a\n" * 30_000 + "Figura 2"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.text for r in repair.without_axis_lines(df, ["id"]).collect()}
    want = {i: None if t is None else axis_free(t) for i, t in enumerate(texts)}
    assert sum(w != t for w, t in zip(want.values(), texts, strict=True)) > 50
    assert got == want


def test_trimmed_parents(spark):
    rows = [("r", 1, "g", None, "9", True, "Considere a figura seguinte e responda. 9.1. Diga 9.1 x"), ("r", 2, "a", "g", "9.1", False, "Diga"), ("r", 3, "b", "g", "9.2", False, "x"), ("r", 4, "h", None, "3", True, "Curto 3.1. x"), ("r", 5, "c", "h", "3.1", False, "x"), ("r", 6, "k", None, "4", True, "Um texto que tem 14.1 de altura e mais nada."), ("r", 7, "d", "k", "4.1", False, None)]
    df = spark.createDataFrame(rows, "root string, ord long, question_id string, parent string, number string, is_group boolean, statement string")
    assert [tuple(r) for r in repair.trimmed_parents(df).collect()] == [("r", 1, "Considere a figura seguinte e responda.")]


def test_profiles(spark):
    schema = "root string, ord long, number string, group_id string, parent string, type string, statement string, options array<string>, math_heavy boolean"
    rows = [("m", 1, "1", None, None, "open_answer", "Calcule 3/4 de x\nFIM\n", [], False), ("m", 2, "95", "g", None, "open_answer", "texto", [], False), ("h", 1, "95", "g", None, "open_answer", "x = 2", [], False), ("h", 2, "II", None, None, "open_answer", "texto", [], False), ("p", 1, "1", "g", None, "multiple_choice", "Qual é? (A) um (B) dois", ["um"], False), ("p", 2, "1", "g", None, "open_answer", "Qual é? (A) um (B) dois", ["um"], False), ("z", 1, "1", None, None, None, None, None, None), (None, 1, "1", None, None, "x", "a\nFIM\n", [], True)]
    exams = spark.createDataFrame([("m", "Matemática A"), ("h", "História A"), ("p", "Português"), ("z", None)], "root string, subject string")
    q = spark.createDataFrame(rows, schema)
    kept, warned = profiles.normalise(q, exams)
    assert kept.columns == q.columns
    got = {(r.root, r.ord): (r.statement, r.math_heavy) for r in kept.collect()}
    assert got == {("m", 1): ("Calcule 3/4 de x", True), ("m", 2): ("texto", False), ("p", 1): ("Qual é?", False), ("p", 2): ("Qual é? (A) um (B) dois", False), ("z", 1): (None, None), (None, 1): ("a", True)}
    assert {(r.root, r.ord): r.steps for r in warned.collect()} == {("m", 1): ["scoring_tail", "formulas"], ("h", 1): ["line_numbers"], ("h", 2): ["no_question"], ("p", 1): ["inline_options"], (None, 1): ["scoring_tail"]}
    same, none = profiles.normalise(q, exams, steps=[])
    assert none.isEmpty() and sorted(map(str, same.collect())) == sorted(map(str, q.collect()))


def test_wide_rows_are_compiled(spark, tiny):
    """No function on lists takes the model's rows out of generated code, and no stage's method is too large for Java to compile."""
    from assaylake.plans import QUERIES

    QUERIES["q_rules_generic"](spark, tiny)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    wide = exams.model(spark, tiny).questions
    row = wide.orderBy("root", "ord").first()
    assert isinstance(row.options, list) and isinstance(row.blanks, list)
    lists = exams._at([[["a"], []], [["b"]]], "array<string>", "i", "j")
    told = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (None, 0), (-1, 0)], "i long, j long").select(lists.alias("x"))
    assert [r.x for r in told.collect()] == [[["a"], []][0], [], ["b"], [], [], []]
    assert "lambdafunction" not in told._jdf.queryExecution().executedPlan().toString()

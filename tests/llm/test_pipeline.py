"""The pipeline's stages against brute force, each on what the one before kept."""

import re

import corpus_pipeline
from quillon.llm import ngram_join  # noqa: F401

from .test_operators import linked, prose, rows_of, shingles


def test_stages(spark, tmp_path):
    items = {k: prose(900 + k, 40) for k in range(4)}
    texts = {i: prose(i, 80 + i) for i in range(30)}
    texts |= {40: texts[3], 41: texts[4].replace(texts[4].split()[40], "edit", 1), 42: None, 43: "12 34 !", 44: "", 45: 'x password = "abc12345" ' + prose(7000, 60), 46: prose(8000, 1500)}
    texts |= {50 + k: prose(5000 + k, 60) + " " + items[k] + " " + prose(6000 + k, 30) for k in range(4)}
    texts[60] = texts[50].replace(texts[50].split()[3], "near", 1)
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or ""), "extra") for i, t in texts.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, sid string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    # brute force
    kept = {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    least = linked({i: shingles(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if least[i] == i}
    norm = lambda t: " ".join(t.lower().split())
    kept = {i: t for i, t in kept.items() if not any(norm(x) in norm(t) for x in items.values())}
    secret = re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""")
    kept = {i: secret.sub("[secret]", t) for i, t in kept.items()}

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name == "redact":
            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows_of(docs)} == {i: (t, len(t)) for i, t in kept.items()}
    assert sizes[0] == len(texts) - 3 and sizes == sorted(sizes[:4], reverse=True) + sizes[4:]
    pieces = rows_of(docs)
    assert {r["doc_id"] for r in pieces} == set(kept) and max(r["offset"] + r["length"] for r in pieces) <= 1024


def test_rows_not_ids(spark, tmp_path):
    """Repeated rows and doc_ids, null ids, texts that differ in case alone, and columns named like the operators' own."""
    a, b, c, item = prose(1, 70), prose(2, 80), prose(3, 60), prose(900, 40)
    near = b.replace(b.split()[40], "edit", 1)
    rows = [(1, a), (2, a), (2, b), (5, near), (7, c), (7, c), (7, c.upper()), (None, a), (None, a), (8, None), (9, "7 8"), (9, prose(5, 30)), (10, item), (10, prose(6, 50)), (None, item), (2, prose(7, 50)), (5, "one two"), (6, "One\ttwo")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, lang_pred int, `group` int, secret_spans string, tags map<string,int>"
    full = [(i, t, "en", "s", len(t or ""), 0.5, "r", 1, 2, "u", {"k": 1}) for i, t in rows]
    spark.createDataFrame(full, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (None, prose(901, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = sorted(((r["doc_id"] or 0, r["text"], r["secret_spans"], r["score"]) for r in rows_of(docs)))
    assert sorted(t[:2] for t in seen["language_id"]) == sorted((i or 0, t) for i, t in rows if t and any(x.isalpha() for x in t))
    (seventh,) = [t for t in seen["near_duplicates"] if t[0] == 7]
    assert seventh[1] in (c, c.upper())
    want = [(0, a), (0, a), (0, item), (1, a), (2, b), (2, prose(7, 50)), (5, "one two"), (9, prose(5, 30)), (10, item), (10, prose(6, 50))]
    assert sorted(t[:2] for t in seen["near_duplicates"] if t[0] != 7) == sorted(want)
    assert sorted(t[:2] for t in seen["decontaminate"] if t[0] != 7) == sorted(t for t in want if t[1] != item)
    assert all(t[2:] == ("u", 0.5) for t in seen["redact"]) and len(seen["redact"]) == len(seen["decontaminate"])
    assert {(r["doc_id"] or 0) for r in rows_of(corpus_pipeline.run(spark, str(tmp_path)))} == {0, 1, 2, 5, 7, 9, 10}


def test_empty(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

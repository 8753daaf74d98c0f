"""The pipeline on the smallest tables: stages keep columns, decisions take effect, the rest still imports without them."""

import os
import re
import shutil
import subprocess
import sys
from collections import Counter

import corpus_pipeline
from meshlag.llm.decontamination import shingles_of
from meshlag.llm.queries import ORACLE_SQL, QUERIES

from test_text_operators import prose


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen, now = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, sf_dir).collect(), docs.schema)
        assert now.columns == docs.columns
        seen.append(now.count())
    assert docs.count() >= seen[0] >= seen[1] >= seen[2] >= seen[3] > 0
    items = [s for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if (s := shingles_of(r["text"]))]
    for r in now.collect():
        s = shingles_of(r["text"])
        assert all(len(i & s) < 0.8 * len(i) for i in items)
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in now.select("doc_id").collect()}


def small_tables(spark, folder, docs):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double, k int, row string").write.parquet(f"{folder}/documents.parquet")
    texts = {i: t for i, t, *_ in docs}
    rows = [(i, int("!!!" not in (t or "")), int("wretchedfool" in (t or ""))) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(500, 30)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeats, rows that share an id or have none, and clashing column names, stage by stage against brute force."""
    texts = [prose(k, 60) for k in range(80)]
    texts += [prose(k, 60).upper().replace(" ", "!!! ") for k in range(80, 110)]
    texts += [prose(k, 30) + " wretchedfool " + prose(k + 1, 30) for k in range(110, 150)]
    texts += [texts[3], texts[3] + " end", texts[4].upper(), prose(600, 20) + " " + prose(500, 30) + " " + prose(601, 20), prose(700, 60_000), None, "", None]
    ids = [*range(len(texts) - 8), 300, 301, 302, 303, 304, 305, 306, None]
    docs = [(i, t, "en", "s", len(t or ""), -7.0, 5, "mine") for i, t in zip(ids, texts, strict=True)]
    docs += [docs[5], docs[6][:1] + (prose(800, 60),) + docs[6][2:], (None, prose(801, 60), "en", "s", 1, -7.0, 5, "mine")]
    small_tables(spark, tmp_path, docs)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kinds, seen = now.schema, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = Counter(tuple(r) for r in now.collect())
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns, name
        after = Counter(tuple(r) for r in out.collect())
        assert after and not after - before and all(r[5] == -7.0 and r[7] == "mine" for r in after), name
        seen.append((before, after))
        now = spark.createDataFrame([r for r, n in after.items() for _ in range(n)], kinds)
    kept = lambda k: {(r[0], r[1]) for r in seen[k][1]}
    assert not any("!!!" in (t or "") for _, t in kept(0)) and {(i, texts[i]) for i in range(80)} <= kept(0)
    assert not any("wretchedfool" in (t or "") for _, t in kept(1)) and {(i, texts[i]) for i in range(80)} <= kept(1)
    # near-duplicates by all pairs of distinct texts
    rows = sorted(kept(1), key=lambda r: (r[0] is None, r[0] or 0))
    bodies = list(dict.fromkeys(t or "" for _, t in rows))
    words = [re.findall(r"[^\W_]+", t.lower()) for t in bodies]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {t} for w, t in zip(words, bodies, strict=True)]
    label = list(range(len(bodies)))
    for a in range(len(bodies)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    of = {t: label[k] for k, t in enumerate(bodies)}
    first = {}
    for i, t in rows:
        first.setdefault(of[t or ""], i)
    assert Counter(of[t or ""] for _, t in kept(2)) == Counter(dict.fromkeys(first, 1)) and {i for i, _ in kept(2)} == set(first.values())
    assert sum(seen[2][1].values()) == len(first)
    item = shingles_of(prose(500, 30))
    assert kept(3) == {r for r in kept(2) if len(item & shingles_of(r[1] or "")) < 0.8 * len(item)} != kept(2)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in out if r["start"] == 0) == Counter(i for i, _ in kept(3))


def test_pipeline_on_empty_tables(spark, tmp_path):
    small_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{k}" for k in range(1, 11)), "pipeline"}


def test_rest_imports_without(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(os.path.join(root, "meshlag"), tmp_path / "meshlag", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op1_') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)

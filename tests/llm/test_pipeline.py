import hashlib
import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import brute
import corpus_pipeline
import public_tokenizers
from gleaner.llm import bpe, mixing, quality

ROOT = Path(__file__).resolve().parent.parent.parent


def planted():
    """Clean documents, copies, near copies, junk, short ones, and a passage that several share."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage = prose(60)
    texts = ["\n".join(prose(rng.randint(20, 60)) for _ in range(4)) for _ in range(150)]
    texts += [texts[i] for i in range(5)]
    for i in range(10, 20):
        words = texts[i].split(" ")
        for line in range(3):  # a change in each line, so that line dedup leaves a near copy
            words[line * 25 + 5] = "changed"
        texts.append(" ".join(words))
    texts += [f"{prose(70)}\n{passage}\n{prose(40)}" for _ in range(4)]
    texts += [" ".join(w + "###" for w in prose(80).split()) for _ in range(12)] + [prose(20), "", None]
    return [(i, t, rng.choice(["en", "de"]), f"src{rng.choice([0, 0, 0, 1, 2])}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(planted(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_run_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    # 1: the outlier verdicts are the operator's own (its test holds them against planted outliers)
    kept = {r.doc_id for r in quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("_kept").collect()}
    assert kept == {i for i, r in docs.items() if r.text and "###" not in r.text and not brute.base_quality(r.text)[-1]}
    # 2: line dedup; documents that are repeats only go
    texts = brute.dedup_lines([(i, docs[i].text) for i in sorted(kept)])
    texts = {i: t for i, t in texts.items() if brute.words_of(t)}
    assert not set(range(150, 155)) & set(texts)
    # 3: one document of each group
    rows = sorted(texts.items())
    rows = [row for row, (_, component, _) in zip(rows, brute.jaccard_classes(rows, 5, 80)) if component == row[0]]
    # 4: copies
    domain = {"src0": "web", "src1": "books", "src2": "code"}
    flat = [(i, (domain[docs[i].source], docs[i].lang, docs[i].source), len(brute.words_of(t))) for i, t in rows]
    copies = brute.mix(flat, [mixing.WEIGHTS[level] for level in mixing.LEVELS], 100, mixing.MAX_EPOCHS, mixing.SEED)
    # 5: digests
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load().ranks, special_tokens={})
    expected = []
    for (i, t), n in zip(rows, copies):
        ids = library.encode_ordinary(t)
        expected += [(i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] * n
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(expected) and len(got) > 100


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    out = corpus_pipeline.line_dedup(spark, docs, sf_dir)
    assert out.filter(F.col("n_chars") != F.length("text")).count() == 0


@pytest.mark.parametrize("gone", [("gleaner/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_the_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        (shutil.rmtree if (copy / name).is_dir() else Path.unlink)(copy / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert done.returncode == 0, done.stderr

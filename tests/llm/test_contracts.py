"""Cases of the contracts: special strings, extreme lengths, clashing columns, an empty folder of the subpackage."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strataloom.llm import byte_bpe, cover_tree, decontaminate, ngram_join, pii, token_file, toxicity

ROOT = Path(__file__).resolve().parents[2]


def test_special_strings_are_one_id_as_in_the_library():
    own, whole = token_file.WordTokenizer(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rnd = random.Random(2)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "A", "é.", "\n", "12"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(8))) for _ in range(400)]
    assert [np.frombuffer(i, own.kind).tolist() for i in own.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e300, 5e-324])
def test_near_vectors_of_any_length(spark, size):
    rows = [(1, [size, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, size], 1), (4, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.near_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _d string, _D_ string, _k string, _r string, n_card long, n_words long, row long, key string"


def clashing(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "d", "D", "k", "r", 77, 78, 79, "key") for d, t in rows], CLASHING)


def test_stages_keep_columns_of_any_name(spark):
    words = " ".join(f"word{k}" for k in range(40))
    rows = [(1, words), (2, words), (3, "leaked passage of ten words that a benchmark item also holds here"), (4, None), (None, "my card 4111 1111 1111 1111"), (None, ""), (5, "short")]
    docs = clashing(spark, rows)
    items = spark.createDataFrame([(9, rows[2][1], "x", "y")], "item_id long, text string, _d string, _k string")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "None", "None"])
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(["1", "2", "4", "5", "None", "None"])
    hidden = corpus_pipeline.replace_personal(spark, docs, "")
    assert hidden.columns == docs.columns and {r.n_card for r in hidden.collect()} == {77}
    assert "4111" not in " ".join(r.text or "" for r in hidden.collect())
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.accepted(docs, labels).columns == docs.columns


def test_stages_on_empty_tables(spark):
    docs = clashing(spark, [])
    items, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (ngram_join.one_of_each(docs), decontaminate.clean(docs, items), corpus_pipeline.replace_personal(spark, docs, ""), toxicity.accepted(docs, labels)):
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.encode(spark, docs, "").count() == 0


def test_borders_of_bpe_tokens_from_their_definition():
    """Two tokens may stand side by side if plain merging of their bytes gives just them."""
    ranks = byte_bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks

    def merged(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((ranks.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    rnd, tokens = random.Random(5), list(ranks.ranks)
    pairs = [(rnd.choice(tokens), rnd.choice(tokens)) for _ in range(3000)]
    pairs += [(t[:k], t[k:]) for t in rnd.sample(tokens, 3000) for k in range(1, len(t)) if t[:k] in ranks.ranks and t[k:] in ranks.ranks]
    pairs += [(b"a" * n, b"a" * m) for n in range(1, 9) for m in range(1, 9) if b"a" * n in ranks.ranks and b"a" * m in ranks.ranks]
    met = 0
    for a, b in pairs:
        if merged(a) == [a] and merged(b) == [b]:
            want = merged(a + b) == [a, b]
            met += want
            assert ranks.beside(ranks.ranks[a], ranks.ranks[b]) == want, (a, b)
    assert 500 < met < len(pairs)


def test_the_rest_lives_beside_an_empty_subpackage(tmp_path):
    shutil.copytree(ROOT / "strataloom", tmp_path / "strataloom", ignore=lambda d, names: names if d.endswith("llm") else [n for n in names if n == "__pycache__"])
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 200, len([q for q in e.queries() if q.startswith('op1')]))"], cwd=tmp_path, capture_output=True, text=True, timeout=120,
        env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)},
    )
    assert said.stdout.split() == ["True", "0"], said.stderr[-2000:]

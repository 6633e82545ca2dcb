"""The registered queries on the smallest tables: their stated columns against plain Python and SQL."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assetlake.llm import language_id, packing, registry, toxicity

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def docs():
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    return {i: text or "" for i, text in rows}


def rows(spark, name):
    return registry.queries()[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in duck.description]
    made = registry.queries()[name](spark, DATA)
    assert sorted(made.columns) == sorted(columns)
    assert sorted((tuple(r) for r in made.select(*columns).collect()), key=str) == sorted(duck.fetchall(), key=str)


def test_language_model_base(spark, docs):
    fold = lambda text: "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    tokens = {i: [*WORD.findall(fold(text)), None] for i, text in docs.items()}
    counts = Counter(t for i, own in tokens.items() if remainder(i, 7) != 2 for t in own)
    total, distinct = sum(counts.values()), len(counts)
    got = rows(spark, "op3_lm_scoring")
    assert len(got) == len(docs)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(r.doc_id, 7) == 2, len(own), sum(t in counts for t in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own), rel=1e-9)
        assert r.score < 0


def test_quality_rules_base(spark, docs):
    got = rows(spark, "op5_quality_rules")
    assert len(got) == len(docs)
    for r in got:
        text = docs[r.doc_id]
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.kept and failed)


def test_packing(spark, docs):
    plain, pieces, sequences = Tokenizer.from_file(packing.default_tokenizer()), {}, {}
    for r in rows(spark, "op4_packing"):
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(pieces) == sorted(docs)
    for i, own in pieces.items():
        ids = np.array([*plain.encode(docs[i], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.05 * math.ceil(sum(r.length for own in pieces.values() for r in own) / 4096) + 1


def test_held_out_labels_teach_nothing(spark, tmp_path):
    """Other labels of held-out rows leave every score as it was."""
    d = str(tmp_path)
    for t in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{d}/same/{t}.parquet")
    labels, documents = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "documents"))
    mod = lambda n: F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))
    labels.withColumn("toxic", F.when(mod(3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{d}/other/labels.parquet")
    documents.withColumns({"lang": F.when(mod(4) == 2, "xx").otherwise(F.col("lang")), "source": F.lit("s")}).write.parquet(f"{d}/other/documents.parquet")
    for query in (toxicity.op2_toxicity, language_id.op7_language_id):
        one, other = ({r.doc_id: tuple(r) for r in query(spark, f"{d}/{x}").collect()} for x in ("same", "other"))
        assert one == other and len(one) == documents.count()
        assert all(0 <= r[2 if query is toxicity.op2_toxicity else 3] <= 1 for r in one.values())

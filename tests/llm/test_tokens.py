"""Token files: their order, and reading some of them."""

from __future__ import annotations

import glob

import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from tenderflow.llm import token_columns, tokens
from tenderflow.llm.common import running_total

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


def test_names_of_special_tokens_as_the_library_takes_them():
    texts = ["a <|endoftext|> b", "<|startoftext|>Ä b.", "plain text", "<|endoftext|>", "<|endoftext|", None]
    for path, kind in ((BYTE, "byte"), (WORD, "word")):
        want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids + [9] for t in texts]
        ids, sizes = tokens.Encoder(path, kind).encode(texts, 9)
        at = 0
        for own, n in zip(want, sizes.tolist(), strict=True):
            assert ids[at : at + n].tolist() == own
            at += n


def test_ends_of_words_and_lines_as_the_library_takes_them():
    words = ["a", "Word.", "É,", "don't,", "12.", "12,", "x...", "q!!", "$$$", ".", ",", "中,", "²,", "z's", "b\x00c", "\x01", "83.2,", "ｱ.", "q$.", "\u0301,", "À", "Á."]
    ends = [" ", "\n", "\n\n", "\n\n\n", "  ", " \n", "\t", "\x1c"]
    texts = [a + e + b + f for a in words for b in words for e in ends for f in ("", ".", "\n")] + ["", None, "\n", " ", ".", ", a"]
    for path, kind in ((BYTE, "byte"), (WORD, "word")):
        library, own = Tokenizer.from_file(path), tokens.Encoder(path, kind)
        want = [e.ids + [9] for e in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        for at in range(0, len(texts), 1000):
            ids, sizes = own.encode(texts[at : at + 1000], 9)
            assert sizes.tolist() == [len(w) for w in want[at : at + 1000]]
            assert ids.tolist() == [i for w in want[at : at + 1000] for i in w]


def test_new_words_reach_the_model_many_at_once(monkeypatch):
    words = ["".join(chr(97 + (i * 7**k >> 2 * k) % 26) for k in range(8)) + ("é" if i % 3 else "") for i in range(9000)]
    texts = [" ".join(words[i : i + 30]) + ".\nAnd so," for i in range(0, len(words), 30)]
    library, own, calls = Tokenizer.from_file(BYTE), tokens.Encoder(BYTE, "byte"), []

    class Model:
        def tokenize(self, text, of=own.model):
            calls.append(text)
            return of.tokenize(text)

    class Library:
        def encode_batch_fast(self, segments, of=own.tokenizer, **options):
            calls.extend(segments)
            return of.encode_batch_fast(segments, **options)

    monkeypatch.setattr(own, "model", Model())
    monkeypatch.setattr(own, "tokenizer", Library())
    ids, _ = own.encode(texts, 9)
    assert ids.tolist() == [i for e in library.encode_batch_fast(texts, add_special_tokens=False) for i in [*e.ids, 9]]
    assert len(calls) <= 12  # for some 9,000 new segments
    assert [k for k in own.place if k.endswith((".", ","))] == ["\n.", "\n,"]  # they are not learned anew with each word


def test_starts_follow_the_files(spark, tmp_path):
    rows = [(i // 4, f"{'word ' * (i * 7 % 11)}{i}") for i in range(60)] + [(None, "none"), (3, None), (3, None), (5, "same"), (5, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "tokens")
    token_columns.write_tokens(token_columns.encode_documents(docs, BYTE), path)
    sums = token_columns.checksums(token_columns.read_tokens(spark, path))
    got = running_total(sums, ["doc_id", "place"], "n_tokens", "start").collect()
    at, want = 0, []
    for file in sorted(glob.glob(f"{path}/part-*")):
        for row in pq.read_table(file).to_pylist():
            want.append((row["doc_id"], row["place"], row["n_tokens"], at))
            at += row["n_tokens"]
    assert sorted(want, key=str) == sorted(((r["doc_id"], r["place"], r["n_tokens"], r["start"]) for r in got), key=str)


def test_selective_reading(spark, tmp_path):
    path = str(tmp_path / "tokens")
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    token_columns.write_tokens(token_columns.encode_documents(docs, BYTE), path)
    some = token_columns.read_documents(spark, path, 100, 120)
    assert sorted(r["doc_id"] for r in some.collect()) == list(range(100, 121))
    lengths = token_columns.read_documents(spark, path, 100, 120, ("doc_id", "n_tokens"))
    plan = lengths._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan and "LessThanOrEqual(doc_id,120)" in plan and "ids" not in plan.split("ReadSchema")[1]
    for file in glob.glob(f"{path}/part-*"):
        meta = pq.ParquetFile(file).metadata
        if meta.num_rows:
            column = meta.row_group(0).column(0)
            assert column.has_column_index and column.has_offset_index and "DELTA_BINARY_PACKED" in column.encodings

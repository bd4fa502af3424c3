"""Merge-dropout against an agenda that is run word by word, the library, and round trips."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from netweave.llm import merge_dropout
from netweave.llm.merge_dropout import SPACE, MergeCoder

PATH = public_tokenizers.path(merge_dropout.MODEL)
DATA = "/root/testdata/sf0.001"
ODD = ["", "  two  spaces ", "tab\tnew\nline", "emoji 😀 ﬁ ß", "a" * 5000, "                                x     ", "你好 世界 " * 20, "▁ a▁b ▁▁", "\x00   ", " " * 300, "ab" * 70 + " " + "-" * 200]


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(50).collect()] + ODD


def brute(own, text, stream):
    """The agenda of each occurrence, symbol by symbol, on strings."""
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    score = {n: model.get_score(i) for n, i in own.ids.items()}
    near = {n[i : i + 2] for n in own.ids for i in range(len(n) - 1)}
    marked = ["mark" if c == SPACE else SPACE if c == " " else c for c in " " + text] if text else []
    units = []
    for c in marked:
        if units and len(c) == len(units[-1][-1]) == 1 and units[-1][-1] + c in near:
            units[-1].append(c)
        else:
            units.append([c])
    out = []
    keys = own.keys(np.full(len(units), stream), np.arange(len(units)))
    for key, part in zip(keys[:, None], units):
        place, skipped = list(range(len(part))), set()
        while True:
            found = [(-score[x + y], a) for a, (x, y) in enumerate(zip(part, part[1:])) if "mark" not in (x, y) and x + y in score and (place[a], x + y) not in skipped]
            if not found:
                break
            a = min(found)[1]
            piece = part[a] + part[a + 1]
            if own.level and own.dropped(key, np.array([place[a]]), np.array([own.ids[piece]]))[0]:
                skipped.add((place[a], piece))
                continue
            part[a : a + 2] = [piece]
            del place[a + 1]
        for p in part:
            out += own.bytes[list(SPACE.encode())].tolist() if p == "mark" else [own.ids[p]] if p in own.ids else own.bytes[list(p.encode())].tolist()
    return out


@pytest.mark.parametrize("dropout", [0.1, 0.5])
def test_drops_of_each_occurrence(texts, dropout):
    own = MergeCoder(PATH, dropout)
    some = [t[:1500] for t in texts[::4] + ODD]
    streams = [5 * i - 70 for i in range(len(some))]
    for text, stream, got in zip(some, streams, own.encode_all(some, streams)):
        assert got.tolist() == brute(own, text, stream)


def test_without_drops_ids_are_the_library_s(texts):
    library, own = sentencepiece.SentencePieceProcessor(model_file=PATH), MergeCoder(PATH, 0.0)
    plain = [t for t in texts if SPACE not in t]
    for text, got in zip(plain, own.encode_all(plain, [0] * len(plain))):
        assert got.tolist() == library.encode(text)


def test_every_text_decodes(texts):
    for dropout in (0.0, 0.1, 0.5, 1.0):
        own = MergeCoder(PATH, dropout)
        ids, sizes = own.encode_flat(texts, np.arange(len(texts)))
        assert [d.decode() for d in own.decode_flat(ids, sizes)] == texts
    # A text gets the same ids whatever is encoded beside it.
    own = MergeCoder(PATH, 0.3)
    together = own.encode_all(texts, list(range(len(texts))))
    assert all(own.encode_all([t], [i])[0].tolist() == x.tolist() for i, (t, x) in enumerate(zip(texts, together)))


def test_heap_and_matrix_agree(texts):
    own = MergeCoder(PATH, 0.2)
    word = own.of_char[[ord(c) for c in SPACE + "internationalisation"]]
    for key in own.keys(np.arange(200), np.arange(200))[:, None]:
        symbols = word.copy()
        own._agendas(symbols, np.array([0]), np.array([len(word)]), 24, key)
        assert symbols.tolist() == own.agenda(word, key).tolist()


def test_segmentations_vary(spark):
    word = "international"
    own = MergeCoder(PATH, 0.3)
    text = " ".join([word] * 400)
    assert len(_words(own, own.encode_all([text], [1])[0])) > 12
    assert len({tuple(own.encode_all([text], [s])[0].tolist()) for s in range(4)} | {tuple(MergeCoder(PATH, 0.3, seed=21).encode_all([text], [0])[0].tolist())}) == 5
    df = spark.createDataFrame([(i, word + " " + word) for i in range(300)], "doc_id long, text string")
    rows = merge_dropout.encode(df, dropout=0.3).collect()
    assert all(r["lossless"] for r in rows) and len({tuple(r["ids"]) for r in rows}) > 100
    assert any(len(_words(own, r["ids"])) == 2 for r in rows)


def _words(own, ids):
    """The distinct segmentations of the words of ``ids``."""
    words = []
    for i in ids:
        if bytes(own.raw[own.raw_start[i] : own.raw_start[i] + own.raw_size[i]]).startswith(b" "):
            words.append([])
        words[-1].append(int(i))
    return {tuple(w) for w in words}


@pytest.mark.parametrize("dropout", [0.0, 0.1])
def test_tables_of_hard_rows(spark, hard, dropout):
    rows = merge_dropout.decode(merge_dropout.encode(hard, dropout=dropout)).collect()
    want = Counter((r["doc_id"], r["text"] or "") for r in hard.collect())
    assert Counter((r["doc_id"], r["decoded"]) for r in rows) == want and all(r["lossless"] for r in rows)
    twice = [r["ids"] for r in rows if r["doc_id"] == 1]
    assert twice[0] == twice[1] and all(len(r["ids"]) == 0 for r in rows if r["doc_id"] in (2, 3))
    assert merge_dropout.decode(merge_dropout.encode(hard.limit(0))).count() == 0
    null = spark.range(1).select(F.lit(None).cast("array<int>").alias("ids"), F.lit("x").alias("decoded_"))
    assert merge_dropout.decode(null).first()["decoded"] == ""


def test_op2_covers_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = merge_dropout.op2(spark, DATA).collect()
    assert len(rows) == docs.count() and all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in rows)

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panmixia.llm import packing


def check(rows, given):
    """Each document's pieces join up to its ids; each sequence is gapless and fits."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == given.keys()
    for i, own in pieces.items():
        ids = np.array([*tokenizer.encode(given[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding, len(sequences)


def test_round_trip(documents, texts):
    padding, _ = check(packing.pack(documents.coalesce(1)).collect(), texts)
    assert padding < 2048


def test_several_tasks_and_small_buffers(documents, texts, monkeypatch):
    padding, _ = check(packing.pack(documents.repartition(3, "doc_id")).collect(), texts)
    assert padding <= 3 * 2048


def test_ids_are_given_on_request(documents):
    r = packing.pack(documents.limit(3).coalesce(1), with_ids=True).first()
    assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]


def test_awkward(awkward, empty):
    unique = awkward.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    check(packing.pack(unique).collect(), {r["doc_id"]: r["text"] for r in unique.collect()})
    rows = packing.pack(awkward).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 2 * 8
    assert packing.pack(empty).count() == 0


def test_tokenizer_equals_the_library():
    t = packing.WordTokenizer(__import__("public_tokenizers").path("word_bpe_49k.json"))
    texts = ["a. b, c.. d ., ÉCOLE. Ωmega Σίσυφος, don't it's l'été K 12.5, naïve…  x　y \x1cq \x85z", "", "..", ", .", "É", "é.", " a  b\n", "Ａ. ﬁ, ½. Ⅷ,"]
    for some in (texts, [*texts, "x <|endoftext|> <|EndOfText|> y"]):
        plain = [np.array(e.ids, "<u4").tobytes() for e in t.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert t.encode(pa.array(some)).to_pylist() == plain == t.encode(pa.array(some)).to_pylist()


def test_old_words_come_back(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    t = packing.WordTokenizer(__import__("public_tokenizers").path("word_bpe_49k.json"))
    for some in (["alpha beta. gamma"], ["delta, alpha epsilon"], ["beta. beta zeta, eta"], ["alpha beta. gamma"]):
        assert t.encode(pa.array(some)).to_pylist() == [np.array(t.tokenizer.encode(some[0], add_special_tokens=False).ids, "<u4").tobytes()]


def test_new_words_reach_the_tokenizer_in_parts():
    t = packing.WordTokenizer(__import__("public_tokenizers").path("word_bpe_49k.json"))
    library, sizes = t.tokenizer, []

    class Spy:
        def __init__(self, model):
            self.model = model

        def encode_batch_fast(self, texts, **options):
            sizes.append(sum(len(x.split()) for x in texts))
            return self.model.encode_batch_fast(texts, **options)

    t.tokenizer, t.plain = Spy(t.tokenizer), Spy(t.plain)
    letters = ["".join(chr(97 + k // 26**n % 26) for n in range(4)) for k in range(9_000)]
    text = " ".join([*letters, *(f"é{w}" for w in letters), *(f"{w}7" for w in letters)])
    assert t.encode(pa.array([text])).to_pylist() == [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert sum(sizes) == 27_000 and max(sizes) <= 4_000


def test_both_fronts_share_one_model():
    t = packing.WordTokenizer(__import__("public_tokenizers").path("word_bpe_49k.json"))
    t.tokenizer.model.dropout = 0.5
    assert t.plain.model.dropout == 0.5

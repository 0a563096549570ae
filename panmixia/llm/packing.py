"""Packing: documents routed to context-size tiers, windows filled from shorter tiers."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from panmixia.llm.common import slices, trimmed

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens held by a task before it packs them, words whose ids it remembers, bytes of text that are encoded at once, and
#: new words (or texts) that the tokenizer gets at once, since what it holds meanwhile is many times their size.
BUFFER_TOKENS, CACHED_WORDS, ENCODED_BYTES, NEW_WORDS = 2_000_000, 200_000, 1_500_000, 4_000
STEP_TOKENS = 8 * TIERS[-1]


class WordTokenizer:
    """Ids of a tokenizer that never joins across white space, word by word.

    Most words recur, so each is encoded once. New words of letters are encoded together in one string
    and told apart by the end-of-word marks of their last pieces; a word with a final dot or comma
    has the ids of the two parts. Everything else is encoded alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from tokenizers import normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model, not a copy, behind a cheaper front, for words of lower-case ASCII letters alone
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.marks = {p: self._ids([p.decode()])[0] for p in (b".", b",")}

    def _ids(self, texts: list[str], plain: bool = False) -> list[bytes]:
        model, out = self.plain if plain else self.tokenizer, []
        for k in range(0, len(texts), NEW_WORDS):
            out += [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch_fast(texts[k : k + NEW_WORDS], add_special_tokens=False)]
        return out

    def _together(self, words: list[bytes], plain: bool) -> list[bytes]:
        """Ids of single words of letters, encoded some thousand in one text; one by one if its pieces don't add up."""
        out: list[bytes] = []
        for k in range(0, len(words), NEW_WORDS):
            some = words[k : k + NEW_WORDS]
            raw = self._ids([b" ".join(some).decode("utf-8", "replace")], plain)[0]
            stops = np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1
            if len(stops) != len(some):
                out += self._ids([w.decode("utf-8", "replace") for w in some])
                continue
            at = [0, *(4 * stops).tolist()]
            out += [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def _learn(self, words: set[bytes]) -> None:
        known, older, marks = self.known, self.older, self.marks
        marked = [w for w in words if w[-1:] in marks]
        words.difference_update(marked)
        words.update(stems := {w[:-1] for w in marked}.difference(known))
        for w in [w for w in stems if w in older] if older else ():
            known[w] = older[w]
            words.discard(w)
        ascii_ = [w for w in words if w.isalpha()]  # lower case by now, so nothing is left to normalise
        rest = [(w, w.decode("utf-8", "replace")) for w in words.difference(ascii_)]
        letters = [w for w, t in rest if t.isalpha()]
        other = [(w, t) for w, t in rest if not t.isalpha()]
        known.update(zip(ascii_, self._together(ascii_, plain=True), strict=True))
        known.update(zip(letters, self._together(letters, plain=False), strict=True))
        known.update(zip([w for w, _ in other], self._ids([t for _, t in other]) if other else [], strict=True))
        for w in marked:
            stem = w[:-1]
            if stem.isalpha() or stem.decode("utf-8", "replace").isalpha():
                known[w] = known[stem] + marks[w[-1:]]
            else:
                known[w] = self._ids([w.decode("utf-8", "replace")])[0]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Each text's ids, as little-endian unsigned 32-bit numbers; null as empty."""
        texts = pc.fill_null(texts, "")
        if pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are such in one case only
            return pa.array(self._ids(texts.to_pylist()), pa.binary())
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = split.flatten().dictionary_encode()
        own = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.known) + len(own) > CACHED_WORDS:
            # what is still in use comes back from the older half, the rest goes
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = {w for w in own if w not in known}
        if older and (back := [w for w in new if w in older]):
            known.update((w, older[w]) for w in back)
            new.difference_update(back)
        if new:
            self._learn(new)
        ids = pa.array([known[w] for w in own], pa.binary()).take(coded.indices)
        return pc.binary_join(pa.ListArray.from_arrays(split.offsets, ids), b"")


@lru_cache(maxsize=2)
def word_tokenizer(path: str | None) -> WordTokenizer:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordTokenizer(path)


Piece = tuple[int, int, int]  # document, its start there, length


class Packer:
    """Packs pieces into windows of the tiers' sizes, all full but the last ones.

    A piece of a document takes the smallest tier that holds it; what is longer than the largest
    tier gives full windows first. Windows of long tiers are filled up from the shortest pieces at
    hand, which are cut to fit; so a short document is cut rarely and a long one only at window ends.
    """

    def __init__(self):
        self.tiers: dict[int, deque[Piece]] = {t: deque() for t in (0, *TIERS)}
        self.full: list[tuple[int, list[Piece]]] = []

    def _route(self, piece: Piece, first: bool = False) -> None:
        n = piece[2]
        tier = 0 if n <= TIERS[0] // 2 else next(t for t in TIERS if n <= t)
        (self.tiers[tier].appendleft if first else self.tiers[tier].append)(piece)

    def add(self, doc: int, length: int) -> None:
        start = 0
        while length - start >= TIERS[-1]:
            self.full.append((TIERS[-1], [(doc, start, TIERS[-1])]))
            start += TIERS[-1]
        if length > start:
            self._route((doc, start, length - start))

    def _shortest(self, below: int) -> deque[Piece] | None:
        return next((q for t, q in self.tiers.items() if t <= below and q), None)

    def pack(self) -> None:
        """Fill windows while the pieces last; what cannot fill one stays for the next time."""
        for tier in reversed(TIERS):
            queue = self.tiers[tier]
            while queue:
                window, gap = [queue.popleft()], tier
                gap -= window[0][2]
                while gap and (source := self._shortest(tier)) is not None:
                    doc, start, n = source.popleft()
                    window.append((doc, start, min(n, gap)))
                    if n > gap:
                        self._route((doc, start + gap, n - gap), first=True)
                    gap -= window[-1][2]
                if gap:
                    self.tiers[0].extend(window)
                    break
                self.full.append((tier, window))

    def flush(self) -> None:
        """The rest, in order: windows of the largest size, then falling powers of two, so that nothing is padded."""
        rest = deque(p for t in reversed((0, *TIERS)) for p in self.tiers[t])
        for q in self.tiers.values():
            q.clear()
        left = sum(p[2] for p in rest)
        while left:
            size = TIERS[-1] if left >= TIERS[-1] else 1 << (left.bit_length() - 1)
            window, gap = [], size
            while gap:
                doc, start, n = rest.popleft()
                window.append((doc, start, min(n, gap)))
                if n > gap:
                    rest.appendleft((doc, start + gap, n - gap))
                gap -= window[-1][2]
            self.full.append((size, window))
            left -= size


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"


def pack(docs: DataFrame, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens; one row per piece.

    Each task packs its own documents (no shuffle); only its last few windows are short, and
    those are powers of two. A task's sequences are numbered under its partition, and
    each tier's are dealt to steps of equally many tokens. ``with_ids`` adds the ids themselves.

    Null and empty texts are documents of the end id alone; texts of any length are read whole and
    cut; repeated rows are packed again; an empty table gives no rows; other columns are not read.
    """

    @trimmed
    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = word_tokenizer(tokenizer_path), Packer()
        ids: dict[int, tuple[int | None, bytes]] = {}
        part, made, held, count = TaskContext.get().partitionId() << 40, 0, 0, 0
        steps: dict[int, int] = {}

        def done() -> pa.RecordBatch:
            nonlocal made, held
            rows = []
            for size, window in packer.full:
                at = 0
                used = steps.get(size, 0)
                steps[size] = used + size
                for doc, start, n in window:
                    doc_id, raw = ids[doc]
                    piece = raw[4 * start : 4 * (start + n)]
                    step = part + (size.bit_length() << 32) + used // STEP_TOKENS
                    rows.append((doc_id, start, n, zlib.crc32(piece), len(raw) // 4, part + made, at, size, step, *([piece] if with_ids else [])))
                    at += n
                made += 1
            packer.full.clear()
            left = {p[0] for q in packer.tiers.values() for p in q}
            for k in [k for k in ids if k not in left]:
                del ids[k]
            held = sum(len(x[1]) for x in ids.values()) // 4
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.binary()] * with_ids
            names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for some in slices(batch, ENCODED_BYTES):
                for doc_id, raw in zip(some.column("doc_id").to_pylist(), tokenizer.encode(some.column("text")).to_pylist(), strict=True):
                    ids[count] = (doc_id, raw + end)
                    packer.add(count, len(raw) // 4 + 1)
                    held += len(raw) // 4 + 1
                    count += 1
                if held > BUFFER_TOKENS:
                    packer.pack()
                    yield done()
        packer.pack()
        packer.flush()
        yield done()
        tokenizer.known, tokenizer.older = {}, {}

    return docs.select("doc_id", "text").mapInArrow(packed, SCHEMA + ", ids binary" * with_ids)

"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts of a partition are cut into pre-tokens; the different ones not seen before are laid out as one array of
symbols with links to neighbours.  An index maps each adjacent pair's rank to all positions where it stands;
a heap yields the active ranks in ascending order, each is applied to all its positions at once, and the pairs
that arise or vanish beside them update the affected lists.  As words are independent and the smallest active
rank goes first everywhere, each word's merges come in the order that encoding it alone would take.

The vocabulary file (tokenizers JSON, byte-level BPE) is a parameter; its bytes, a few MB whatever the input,
are broadcast.  Text is handled in pieces of about ``chunk`` characters of whole documents, and the word cache is
cut back at ``cache_words``, so memory is bounded but for one document; smaller ones take less memory and more time.

Cases: null counts as empty; an empty text has no tokens and decodes to an empty text; strings of added
(special) tokens become those tokens, as with the library's defaults; repeated rows are encoded alike; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import tidy

#: Fixed by the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK, CACHE_WORDS = 3_000_000, 300_000
#: Lists of positions up to this length are entered one by one.
SHORT = 12


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The visible letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairIndexBPE:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, vocab_json: bytes):
        spec = json.loads(vocab_json)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.byte_id = np.array([vocab[c] for c in letters], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.triples = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.base = max(max(self.bytes_of), len(vocab)) + 1
        keys = np.array([a * self.base + b for a, b, _ in self.triples], dtype=np.int64)
        self.rank_of = {k: r for r, k in enumerate(keys.tolist())}
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.ids_text: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair never merges."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each non-empty word."""
        n = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(n)
        sym = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.arange(1, len(sym) + 1)
        before = np.arange(-1, len(sym) - 1)
        after[ends - 1] = -1
        before[ends - n] = -1
        self._merge(sym, after, before)
        alive = sym >= 0
        counts = np.add.reduceat(alive, ends - n) if len(n) else n
        return np.split(sym[alive], np.cumsum(counts)[:-1])

    def _merge(self, sym: np.ndarray, after: np.ndarray, before: np.ndarray) -> None:
        """Applies the active ranks in ascending order until none is left.

        Long lists of positions are handled as arrays; the many short ones, for which an array call costs more
        than the work, element by element on views of the same arrays."""
        index: dict[int, list[int]] = {}
        long: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        at_sym, at_after, at_before, base, rank_of = memoryview(sym), memoryview(after), memoryview(before), self.base, self.rank_of

        def enter(places: np.ndarray) -> None:
            ranks = self._ranks(sym[places], sym[after[places]])
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part, r in zip(np.split(places, cuts), ranks[np.r_[0, cuts]].tolist()):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                if len(part) > SHORT:
                    long.setdefault(r, []).append(part)
                else:
                    index[r] += part.tolist()

        def enter_one(p: int) -> None:
            r = rank_of.get(at_sym[p] * base + at_sym[at_after[p]])
            if r is None:
                return
            if r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                heapq.heappush(heap, r)

        enter(np.flatnonzero(after >= 0))
        while heap:
            r = heapq.heappop(heap)
            places, lists = index.pop(r), long.pop(r, None)
            left, right, made = self.triples[r]
            if lists is None and len(places) <= 4 * SHORT:
                for p in sorted(set(places)):
                    if at_sym[p] != left:
                        continue
                    q = at_after[p]
                    if q < 0 or at_sym[q] != right:
                        continue
                    beyond = at_after[q]
                    at_sym[p], at_sym[q], at_after[p] = made, -1, beyond
                    if at_before[p] >= 0:
                        enter_one(at_before[p])
                    if beyond >= 0:
                        at_before[beyond] = p
                        enter_one(p)
                continue
            at = np.unique(np.concatenate([*(lists or ()), np.array(places, dtype=np.int64)]))
            at = at[(sym[at] == left) & (after[at] >= 0)]
            at = at[sym[after[at]] == right]
            if left == right and len(at) > 1:  # runs: from the left, without overlap
                taken, free = [], -1
                for p, q in zip(at.tolist(), after[at].tolist()):
                    if p != free:
                        taken.append(p)
                        free = q
                    else:
                        free = -1
                at = np.array(taken, dtype=np.int64)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            sym[at], sym[gone] = made, -1
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            back = before[at]
            enter(np.concatenate([back[back >= 0], at[inner]]))

    def learn(self, words: set[str]) -> None:
        """Caches the ids (as text) and the decoded bytes of words that are not cached yet."""
        new = [w for w in words if w not in self.ids_text]
        if not new:
            return
        for w, ids in zip(new, self.encode_words([w.encode() for w in new])):
            ids = ids.tolist()
            self.ids_text[w] = ",".join(map(str, ids))
            self.decoded[w] = b"".join(map(self.bytes_of.__getitem__, ids))

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and added tokens in order."""
        if self.split is None or not any(a in text for a in self.added):
            return self.words.findall(text)
        out: list[str] = []
        for part in self.split.split(text):
            out += [part] if part in self.added else self.words.findall(part)
        return out

    def run(self, texts: list[str], cache_words: int = CACHE_WORDS) -> list[tuple[str, bytes]]:
        """(ids joined by commas, decoded text in UTF-8) of each text."""
        cut = [self.pieces(t) for t in texts]
        words = set().union(*cut)
        if len(self.ids_text) > cache_words:  # what this piece uses stays
            self.ids_text = {w: self.ids_text[w] for w in words if w in self.ids_text}
            self.decoded = {w: self.decoded[w] for w in self.ids_text}
        for a, i in self.added.items():
            self.ids_text[a], self.decoded[a] = str(i), self.bytes_of[i]
        self.learn(words)
        out = []
        for words in cut:
            raw = b"".join(map(self.decoded.__getitem__, words))
            out.append((",".join(map(self.ids_text.__getitem__, words)), raw.decode("utf-8", "replace").encode()))
        return out


_coder: dict[str, PairIndexBPE] = {}


def _chunks(batches, chunk: int):
    """(doc_id array, texts) of about ``chunk`` characters."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        at = 0
        while at < batch.num_rows:
            part, size, start = [], 0, at
            while at < batch.num_rows and (not part or size < chunk):
                text = texts[at].as_py() or ""
                part.append(text)
                size += len(text)
                at += 1
            yield ids.slice(start, at - start), part


def _encoder(vocab, name: str, digest: bool, with_ids: bool, chunk: int = CHUNK, cache_words: int = CACHE_WORDS):
    @tidy
    def run(batches):
        if name not in _coder:  # one vocabulary at a time stays in a worker
            _coder.clear()
            _coder[name] = PairIndexBPE(vocab.value)
        coder = _coder[name]
        for ids, texts in _chunks(batches, chunk):
            done = coder.run(texts, cache_words)
            n = pa.array([s.count(",") + 1 if s else 0 for s, _ in done], pa.int64())
            if digest:
                sha = lambda x: hashlib.sha256(x).hexdigest()
                cols = [n, pa.array([sha(s.encode()) for s, _ in done], pa.string()), pa.array([sha(d) for _, d in done], pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                cols, names = [n, pa.array([d.decode() for _, d in done], pa.string())], ["n_tokens", "decoded"]
            if with_ids:
                lists = [np.fromstring(s, dtype=np.int32, sep=",") for s, _ in done]
                cols, names = [*cols, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *cols], ["doc_id", *names])

    return run


def encode_documents(docs: DataFrame, vocab_path: str | None = None, digest: bool = False, with_ids: bool = True, chunk: int = CHUNK, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_tokens, decoded, ids array<int> of every document; with ``digest`` the SHA-256 of the ids joined
    by commas and of the decoded text stand in for the decoded text."""
    with open(vocab_path or default_vocab(), "rb") as file:
        raw = file.read()
    vocab, name = docs.sparkSession.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()
    out = ("ids_sha256 string, decoded_sha256 string" if digest else "decoded string") + ", ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_encoder(vocab, name, digest, with_ids, chunk, cache_words), f"doc_id long, n_tokens long, {out}")


def op6_query(docs: DataFrame) -> DataFrame:
    return encode_documents(docs, digest=True, with_ids=False)

"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last bytes picks cut points, which so depend on content alone: passages that documents share
are cut into the same chunks. A chunk is encoded once in a task and then reused. A cut may fall anywhere, where the two
chunks' encodings need not join; the join is repaired by encoding a window around it again, wider until the tokens at its
edges agree with those of both sides (at last the window holds both chunks). This holds for any vocabulary
(:meth:`ChunkEncoder.whole`).

Where the vocabulary lowers all letters and always parts tokens at white space, which is read off its file and tried on
the library (:meth:`ChunkEncoder.by_words`), a new chunk is put together from its words, each encoded once in a task, and
only the word that a cut went through is encoded again, alone and between its neighbours. Where the two disagree, the
text goes the general way, whose windows widen. Words are parted at the bytes ``BLANKS``; a text with other white space
of one byte (``OTHER``) goes the general way from the start.

Caches are per task and bounded (``CACHE`` entries, then emptied and filled anew): sharing chunks between tasks would
take a shuffle of all texts and of all ids, which is more disk than the encoding may use.

Defined results: a null or empty text has no ids, and the empty string decodes from it; special token strings in a text
become their ids, as in the library; repeated rows are encoded each; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 200_000
SPAN = 32  # tokens around a join, doubled until both sides agree
NEAR = 1024  # bytes looked at for the word before and after a cut one
BLANKS, OTHER = b" \t\n\r", "\x0b\x0c"
WINDOW = 8  # bytes of the rolling hash
MASK = (1 << 10) - 1  # one cut in 1,024 bytes on average
#: Words of these letters alone are one piece for the tokenizer, whose last token carries the word-end mark.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf]|\xc5\x93)+")
END = "</w>"


class ChunkEncoder:
    """Encodes texts exactly like the tokenizer at ``path``, reusing chunks. Works on UTF-8 bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.tokens: list[bytes] = [b""] * (max(vocab.values()) + 1)
        self.ends = np.zeros(len(self.tokens), bool)
        for token, i in vocab.items():
            self.tokens[i], self.ends[i] = token.encode(), token.endswith(END)
        # as decode() joins: without a decoder, tokens are joined by a space
        self.joined = self.lib.decoder is None
        self.ids: dict[bytes, bytes] = {}
        self.said: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}
        self.joins: set[tuple[bytes, bytes, bytes]] = set()
        self.pieces: dict[str, tuple[list[int], list[tuple[int, int]]]] = {}
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.by_words = self._by_words(path)

    def _by_words(self, path: str) -> bool:
        """Whether white space always parts tokens here, case never counts, and marks are always parted from letters: only
        then may words stand for chunks. Read off the vocabulary file, and tried on the library itself."""
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        steps = said.get("normalizer") or {}
        lowers = any(n.get("type") == "Lowercase" for n in steps.get("normalizers", [steps]))
        if not lowers or not self.ends.any():
            return False
        ids = lambda t: self.lib.encode(t, add_special_tokens=False).ids
        tries = ("Ab cd", "a-b c", "x1 y2", "it's so", "no. yes,", "é Ü ß", "a\nb", "a\tb", "a\r\nb", "a\u00a0b")
        return all(ids(t) == ids(t.lower()) == [i for w in t.split() for i in ids(w)] for t in tries) and ids("ab.") == ids("ab .")

    def whole(self, text: str) -> tuple[bytes, bytes]:
        """A text by chunks that the library encodes, each once; joins are repaired by encoding again around them.

        A chunk's tokens are kept with their places. At a join the window from ``SPAN`` tokens before to ``SPAN`` after is
        encoded; where it begins and ends with tokens that both sides have at these places, it replaces what lies between;
        else it is made twice as wide, and at last holds both chunks whole.
        """
        if self.special(text) or len(text) < 2 * SPAN:
            return self.library(text)
        data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        cuts = [0, *cut_points((data & 0xFF).astype(np.uint8)).tolist(), len(text)]
        ids, at = [], []  # of the text so far: token, and (start, end) in it
        for s, e in zip(cuts, cuts[1:], strict=False):
            chunk = text[s:e]
            if not chunk:
                continue
            got = self.pieces.get(chunk)
            if got is None:
                enc = self.lib.encode(chunk, add_special_tokens=False)
                got = enc.ids, enc.offsets
                if len(self.pieces) >= CACHE // 8:
                    self.pieces.clear()
                self.pieces[chunk] = got
            new_ids, new_at = got[0], [(a + s, b + s) for a, b in got[1]]
            if not ids:
                ids, at = list(new_ids), new_at
                continue
            span = SPAN
            while True:
                i, j = max(0, len(ids) - span), min(len(new_ids), span)
                begin = at[i][0] if i else 0
                end = new_at[j - 1][1] if j < len(new_ids) else e
                enc = self.lib.encode(text[begin:end], add_special_tokens=False)
                w_at = [(a + begin, b + begin) for a, b in enc.offsets]
                k = SPAN // 2  # tokens that must agree at each side, unless the window holds the side whole
                left = not i or (enc.ids[:k] == ids[i : i + k] and w_at[:k] == at[i : i + k])
                right = j == len(new_ids) or (enc.ids[-k:] == new_ids[j - k : j] and w_at[-k:] == new_at[j - k : j])
                if left and right:
                    ids[i:], at[i:] = [*enc.ids, *new_ids[j:]], [*w_at, *new_at[j:]]
                    break
                span *= 2
        return np.array(ids, "<u4").tobytes(), self.lib.decode(ids, skip_special_tokens=False).encode()

    def special(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def plain(self, text: str) -> bool:
        """Whether words may stand for chunks in ``text``: no special tokens, and no blanks that words are not parted at."""
        return self.by_words and not self.special(text) and not any(c in text for c in OTHER)

    def library(self, text: str) -> tuple[bytes, bytes]:
        """Ids and decoded text as the library gives them."""
        ids = self.lib.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes(), self.lib.decode(ids, skip_special_tokens=False).encode()

    def _decoded(self, ids: list[int]) -> bytes:
        if self.joined:
            return b" ".join([self.tokens[i] for i in ids])
        return self.lib.decode(ids, skip_special_tokens=False).encode()

    def learn(self, data: bytes) -> None:
        """Words of ``data`` that are not known yet are encoded together."""
        words = set(data.split())
        new = words.difference(self.ids)
        if len(self.ids) + len(new) > CACHE:
            kept = words - new
            self.ids = {w: self.ids[w] for w in kept}
            self.said = {w: self.said[w] for w in kept}
            self.chunks.clear()
            self.joins.clear()
        plain, other = [], []
        for w in new:
            (plain if PLAIN.fullmatch(w) else other).append(w)
        for start in range(0, len(plain), 2000):
            part = plain[start : start + 2000]
            ids = self.lib.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids
            flat = np.array(ids, "<u4")
            stop = np.flatnonzero(self.ends[flat]) + 1
            if len(stop) != len(part):  # not one piece each after all
                other += part
                continue
            raw, at = flat.tobytes(), 0
            for w, e in zip(part, stop.tolist(), strict=True):
                self.ids[w] = raw[4 * at : 4 * e]
                self.said[w] = self._decoded(ids[at:e])
                at = e
        if other:
            for w, e in zip(other, self.lib.encode_batch_fast([w.decode() for w in other], add_special_tokens=False), strict=True):
                ids = e.ids
                self.ids[w], self.said[w] = np.array(ids, "<u4").tobytes(), self._decoded(ids)

    def _inside(self, chunk: bytes) -> tuple[bytes, bytes]:
        """Ids and decoded text of a chunk from white space to white space."""
        got = self.chunks.get(chunk)
        if got is None:
            words = chunk.split()
            got = b"".join(map(self.ids.__getitem__, words)), b" ".join(filter(None, map(self.said.__getitem__, words)))
            if len(self.chunks) >= CACHE // 8:
                self.chunks.clear()
            self.chunks[chunk] = got
        return got

    def _repaired(self, left: bytes, word: bytes, right: bytes) -> tuple[bytes, bytes] | None:
        """The word that a cut went through, encoded again alone and between its neighbours. None if the two disagree."""
        key = (left[-3:], word, right[:3])
        if key in self.joins:
            return self.ids[word], self.said[word]
        alone = self.library(word.decode())
        if self.library(b" ".join([left, word, right]).decode())[0] != self.ids[left] + alone[0] + self.ids[right]:
            return None
        self.joins.add(key)
        return alone

    def encode(self, data: bytes, joins: list[tuple[int, int]]) -> tuple[bytes, bytes] | None:
        """Ids (little-endian, 32 bits) and decoded text; ``joins`` are the blanks before and after each cut word.

        None if a join can't be repaired so. All words of ``data`` have been learned.
        """
        ids, said, pos = [], [], 0
        for a, b in joins:
            if a < pos or b <= a:
                continue  # no blank since the last join: the cut lies in the same word
            left, word = data[pos:a], data[a + 1 : b]
            parts = [self._inside(left)]
            before, after = data[max(pos, a - NEAR) : a].split()[-1:], data[b + 1 : b + 1 + NEAR].split()[:1]
            if word and before and after and before[0] in self.ids and after[0] in self.ids:
                done = self._repaired(before[0], word, after[0])
                if done is None:
                    return None
                parts.append(done)
            elif word:  # at an end of the text, or beside a word longer than what was looked at
                parts.append(self._inside(word))
            for i, s in parts:
                ids.append(i)
                if s:
                    said.append(s)
            pos = b
        i, s = self._inside(data[pos:])
        return b"".join([*ids, i]), b" ".join([*said, s] if s else said)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions of content-defined cuts: a rolling hash over the last bytes."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    table = (np.arange(256, dtype=np.uint32) * np.uint32(2654435761)) ^ np.uint32(0x5BD1E995)
    v = table[data]
    h = np.zeros(len(v) - WINDOW, np.uint32)
    for k in range(WINDOW):
        h = (h << np.uint32(1)) ^ v[k : k + len(h)]
    return np.flatnonzero(((h >> np.uint32(5)) & np.uint32(MASK)) == 0) + WINDOW


def prepared(texts: list[str]) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Each text's bytes, with A-Z in lower case and a space before a full stop or comma that ends a word, and its joins.

    Neither change moves a token: the tokenizer lowers all letters, and always parts letters from marks.
    """
    blobs = [t.encode() for t in texts]
    lengths = np.array([len(b) + 1 for b in blobs], np.int64)
    data = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    data = lower[data]
    letter = (data >= 97) & (data <= 122)
    is_blank = np.zeros(256, bool)
    is_blank[list(BLANKS)] = True
    space = is_blank[data]
    mark = (data == 46) | (data == 44)
    at = np.flatnonzero(letter[:-2] & mark[1:-1] & space[2:]) + 1
    ends = np.cumsum(lengths)
    ends += np.searchsorted(at, ends)
    data = np.insert(data, at, 32)
    blank = np.flatnonzero(is_blank[data])
    cuts = cut_points(data)
    k = np.searchsorted(blank, cuts)  # the last byte is a line end
    before = np.where(k > 0, blank[np.maximum(k - 1, 0)], -1)
    after = blank[np.minimum(k, len(blank) - 1)]
    doc = np.searchsorted(ends, cuts, "right")
    starts = np.concatenate([[0], ends[:-1]])
    good = (doc < len(texts)) & (before >= starts[np.minimum(doc, len(texts) - 1)])
    cuts, before, after, doc = cuts[good], before[good], after[good], doc[good]
    split = np.searchsorted(doc, np.arange(len(texts) + 1))
    raw, out = data.tobytes(), []
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        own = slice(split[i], split[i + 1])
        out.append((raw[s : e - 1], list(zip((before[own] - s).tolist(), np.minimum(after[own] - s, e - 1 - s).tolist(), strict=True))))
    return out


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]): ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = ChunkEncoder(path)
        for batch in batches:
            n, start = batch.num_rows, 0
            sizes = [len(t.as_py() or "") for t in batch.column(1)]
            while start < n:  # about a megabyte at a time, whatever the texts' lengths
                end, size = start, 0
                while end < n and (end == start or size + sizes[end] <= 1_000_000):
                    size += sizes[end]
                    end += 1
                part = batch.slice(start, end - start)
                start = end
                texts = [t.as_py() or "" for t in part.column(1)]
                done: list = [None] * len(texts)
                # special tokens are matched before anything is lowered
                some = [k for k, t in enumerate(texts) if t and enc.plain(t)]
                ready = prepared([texts[k] for k in some]) if some else []
                enc.learn(b"\n".join([d for d, _ in ready]))
                for k, (data, joins) in zip(some, ready, strict=True):
                    done[k] = enc.encode(data, joins)
                done = [enc.whole(texts[k]) if d is None else d for k, d in enumerate(done)]
                cols = [
                    part.column(0),
                    pa.array([len(i) // 4 for i, _ in done], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in done]),
                    pa.array([hashlib.sha256(s).hexdigest() for _, s in done]),
                ]
                if keep_ids:
                    cols += [pa.array([i for i, _ in done], pa.binary()), pa.array([s.decode() for _, s in done], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``text_again``: each row's ids decoded by the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            said = [None if i is None else lib.decode(np.frombuffer(i, "<u4").tolist(), skip_special_tokens=False) for i in batch.column(at).to_pylist()]
            yield batch.append_column("text_again", pa.array(said, pa.string()))

    from pyspark.sql import types as T

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text_again", T.StringType())]))

"""SentencePiece encoding that keeps the place of every piece in the source, and decoding.

The text is normalised by longest-prefix look-up in the model's compiled character map (a double-array trie), which
records for every normalised byte the source byte it came from. BPE merges then cut the normalised text into pieces,
and each piece is projected through that alignment to a byte span of the source. Cuts of words are remembered. Where the
map is empty, no look-up can hit and the same alignment is worked out for all bytes at once.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from palimpsest.llm.common import released
from palimpsest.shipping import ship

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message: ints, 4-byte chunks or bytes."""
    at, end = 0, len(raw)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, raw[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield key >> 3, raw[at : at + size]
            at += size


@dataclass
class CharMap:
    """The compiled character map: the longest source prefix that has a replacement."""

    units: np.ndarray
    strings: bytes

    @classmethod
    def parse(cls, blob: bytes) -> CharMap | None:
        if not blob:
            return None
        (size,) = struct.unpack_from("<I", blob)
        return cls(np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :])

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest mapped prefix of ``data[at:]``."""
        units, best = self.units, None
        unit = int(units[0])
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = int(units[node])
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = int(units[node]) & 0x7FFFFFFF
                best = (k - at + 1, self.strings[start : self.strings.index(b"\0", start)])
        return best


@dataclass
class Codec:
    """A BPE model with byte fallback. Not thread-safe: it remembers the cuts of short words."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    charmap: CharMap | None = None
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    unk: int = 0
    unk_surface: str = " ⁇ "

    #: Words remembered by one worker, and the longest remembered.
    REMEMBER, WORD = 250_000, 48

    @classmethod
    def load(cls, path: str) -> Codec:
        with open(path, "rb") as f:
            raw = f.read()
        me = cls()
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                me.pieces.append(piece[1].decode())
                me.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                me.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                if spec.get(3, 1) != 2:
                    raise ValueError("only BPE models are supported")
                if spec.get(24):
                    raise ValueError("white space as a suffix is not supported")
                if 44 in spec:
                    me.unk_surface = spec[44].decode()
            elif number == 3:
                spec = dict(_fields(value))
                me.charmap = CharMap.parse(spec.get(2, b""))
                me.dummy_prefix, me.squeeze, me.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
            elif number == 5 and dict(_fields(value)).get(2):
                raise ValueError("a denormaliser is not supported")
        me._prepare()
        return me

    def _prepare(self) -> None:
        self.index = {
            p: (-s, i)
            for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds, strict=True))
            if k in (NORMAL, USER_DEFINED, UNUSED)
        }
        self.unk = self.kinds.index(UNKNOWN)
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        own = sorted((p for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER_DEFINED), key=len, reverse=True)
        self.own = re.compile("|".join(map(re.escape, own))) if own else None
        self.widest = max((len(p.encode()) for p in own), default=0)
        self.unused = {i for i, k in enumerate(self.kinds) if k == UNUSED}
        # No merge can cross the start of a word if no piece holds a space mark after another character.
        self.by_word = not own and not self.unused and not any(SPACE in p.lstrip(SPACE) for p in self.index)
        # Normalising changes nothing but blanks then.
        self.plain = self.charmap is None and not own and not self.squeeze
        self.rank = {p: cost for p, (cost, _) in self.index.items()}
        # Short words merge many at once where only merges decide and what is no piece becomes bytes.
        self.batched, self.pairs = not own and not self.unused and bool(self.byte_id), None
        self.bytes_of = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds, strict=True)], np.int32)
        self.surface = [
            bytes([int(p[3:5], 16)])
            if k == BYTE
            else b""
            if k == CONTROL
            else self.unk_surface.encode()
            if k == UNKNOWN
            else p.replace(SPACE, " ").encode()
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]
        # A line break that no longer piece holds never merges either.
        breaks = "" if any("\n" in p and len(p) > 1 for p in self.index) else "\n"
        self.units = re.compile(f"{SPACE}+[^{SPACE}{breaks}]*|{f'{breaks}?' if breaks else ''}[^{SPACE}{breaks}]+{f'|{breaks}' if breaks else ''}").findall
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.table = (np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64))
        self.filled = (0, 1)

    # Normalising

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte it came from."""
        if self.plain and text:
            data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            times = np.where(data == 32, len(SPACE.encode()), 1) if self.escape else np.ones(len(data), np.int64)
            lead = [0] * (len(SPACE.encode()) if self.escape else 1) if self.dummy_prefix else []
            where = np.concatenate([np.array(lead, np.int64), np.repeat(np.arange(len(data)), times), [len(data)]])
            text = f" {text}" if self.dummy_prefix else text
            return text.replace(" ", SPACE) if self.escape else text, where
        return self.normalise_by_prefix(text)

    def normalise_by_prefix(self, text: str) -> tuple[str, np.ndarray]:
        """The same by longest-prefix look-ups: a replacement came from the first byte of what it replaces."""
        data = text.encode("utf-8", "surrogatepass")
        out, where = bytearray(), []
        mark = SPACE.encode() if self.escape else b" "
        at, end, seen_space = 0, len(data), self.squeeze
        if self.squeeze:
            while at < end:
                size, new = self._prefix(data, at)
                if new.strip(b" "):
                    break
                at += size
        if at == end:
            return "", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out += mark
            where += [at] * len(mark)
        while at < end:
            size, new = self._prefix(data, at)
            same = new == data[at : at + size]
            if self.squeeze and seen_space:
                new = new.lstrip(b" ")
            if new:
                for k, byte in enumerate(new):
                    if byte == 32:
                        out += mark
                        where += [at] * len(mark)
                    else:
                        out.append(byte)
                        where.append(at + k if same else at)
                seen_space = new.endswith(b" ")
            at += size
            if not self.squeeze:
                seen_space = False
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :]
                end = where[-len(mark)]
                del where[-len(mark) :]
        where.append(end)
        return out.decode("utf-8", "replace"), np.array(where, np.int64)

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        if self.own and (hit := self.own.match(data[at : at + self.widest].decode("utf-8", "ignore"))):
            raw = hit[0].encode()
            return len(raw), raw
        if self.charmap and (hit := self.charmap.longest(data, at)):
            return hit
        lead = data[at]
        size = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
        raw = data[at : at + size]
        try:
            raw.decode()
        except UnicodeDecodeError:
            return 1, "�".encode()
        return size, raw

    # Cutting

    def cut(self, text: str) -> list[str]:
        """The pieces that merging, best score first and leftmost among equals, leaves of normalised ``text``."""
        if not self.own and not self.unused and len(text) <= self.WORD:
            return self._cut_word(text)
        if self.own:
            parts, fixed, at = [], set(), 0
            for hit in self.own.finditer(text):
                parts += text[at : hit.start()]
                fixed.add(len(parts))
                parts.append(hit[0])
                at = hit.end()
            parts += text[at:]
        else:
            parts, fixed = list(text), set()
        n, index = len(parts), self.index
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, int]] = []
        halves: dict[str, tuple[str, str]] = {}

        def propose(i: int, j: int) -> None:
            if i < 0 or j < 0 or i in fixed or j in fixed:
                return
            whole = parts[i] + parts[j]
            if (hit := index.get(whole)) is not None:
                heapq.heappush(agenda, (hit[0], i, j, len(whole)))
                if hit[1] in self.unused:
                    halves[whole] = (parts[i], parts[j])

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            propose(before[i], i)
            propose(i, after[i])

        def split(piece: str) -> list[str]:
            known = index.get(piece)
            if known is None or known[1] not in self.unused or piece not in halves:
                return [piece]
            left, right = halves[piece]
            return split(left) + split(right)

        found = [p for p in parts if p]
        return [q for p in found for q in split(p)] if self.unused else found

    def _cut_word(self, text: str) -> list[str]:
        """The same for a short text: the best of all pairs is looked for anew after each merge."""
        parts, get, none = list(text), self.rank.get, float("inf")
        costs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (best := min(costs)) < none:
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every pair of symbols that merges, in order: both in one number, what the merge costs, and what it gives.

        A piece is the symbol of its id; a character that is no piece has a number beyond them.
        """
        symbol = self.symbols
        for piece, (_, i) in self.index.items():
            symbol[piece] = i
        for piece in self.index:
            for c in piece:
                symbol.setdefault(c, len(self.pieces) + len(symbol))
        found = [
            (symbol[left] << 32 | symbol[right], cost, i)
            for piece, (cost, i) in self.index.items()
            for k in range(1, len(piece))
            if (left := piece[:k]) in symbol and (right := piece[k:]) in symbol
        ]
        found.sort()
        keys, costs, gives = zip(*found, strict=True) if found else ((), (), ())
        return np.array(keys, np.int64), np.array(costs, float), np.array(gives, np.int64)

    def _merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and normalised bytes of all words' pieces, and how many each has: every round merges the best pair of every
        word, first among equals."""
        if self.pairs is None:
            self.symbols: dict[str, int] = {}
            self.pairs = self._pairs()
        keys, costs, gives = self.pairs
        symbol, base = self.symbols, len(self.pieces)
        for c in set("".join(words)) - symbol.keys():
            symbol[c] = base + len(symbol)
        sym = np.fromiter((symbol[c] for w in words for c in w), np.int64, sum(map(len, words)))
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])

        def look(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = left << 32 | right
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            return np.where(hit, costs[at] if len(keys) else 0, np.inf), gives[at] if len(keys) else key

        cost, give = np.full(len(sym), np.inf), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        cost[inner], give[inner] = look(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(cost, starts)
            sizes = np.diff(np.concatenate([starts, [len(sym)]]))
            over = np.repeat(np.isinf(best), sizes)
            if 2 * over.sum() > len(sym):
                done.append((word[over], sym[over]))
                keep = ~over
                sym, word, cost, give = sym[keep], word[keep], cost[keep], give[keep]
                continue
            hits = np.flatnonzero((cost == np.repeat(best, sizes)) & ~over)
            first = hits[np.concatenate([[True], word[hits[1:]] != word[hits[:-1]]])]
            sym[first] = give[first]
            keep = np.ones(len(sym), bool)
            keep[first + 1] = False
            sym, word, cost, give = sym[keep], word[keep], cost[keep], give[keep]
            first -= np.arange(len(first))
            for left in (first[first > 0] - 1, first):
                same = np.append(word[1:] == word[:-1], False)[left]
                cost[left] = np.inf
                left = left[same]
                cost[left], give[left] = look(sym[left], sym[left + 1])
        if done:
            word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
            order = np.argsort(word, kind="stable")
            word, sym = word[order], sym[order]
        # Characters that are no piece become their bytes.
        other = sym >= base
        if not other.any():
            return sym.astype(np.int32), self.bytes_of[sym], np.bincount(word, minlength=len(words))
        names = {symbol_: [self.byte_id[b] for b in c.encode("utf-8", "replace")] for c, symbol_ in symbol.items() if symbol_ >= base}
        parts = [names[i] if i >= base else [i] for i in sym.tolist()]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = np.fromiter((i for part in parts for i in part), np.int32, int(count.sum()))
        return ids, np.where(np.repeat(other, count), 1, self.bytes_of[ids]).astype(np.int32), np.bincount(word, count, len(words)).astype(np.int64)

    def _ids(self, text: str) -> tuple[list[int], list[int]]:
        """Ids and the normalised bytes each covers."""
        ids, sizes = [], []
        for piece in self.cut(text):
            known, raw = self.index.get(piece), piece.encode()
            if known is not None:
                ids.append(known[1])
                sizes.append(len(raw))
            elif self.byte_id:
                ids += [self.byte_id[b] for b in raw]
                sizes += [1] * len(raw)
            elif ids and ids[-1] == self.unk:
                sizes[-1] += len(raw)
            else:
                ids.append(self.unk)
                sizes.append(len(raw))
        return ids, sizes

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first source byte, source byte after the last) of every piece."""
        ids, begins, ends, _ = self.encode_many([text])
        return ids, begins, ends

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and spans of all texts, one after the other, and where each text's start (one more than texts)."""
        if len(self.memo) > self.REMEMBER:
            self._forget()
        aligned = [self.normalise(t) for t in texts]
        units = [(self.units(normal) if self.by_word else [normal]) if normal else [] for normal, _ in aligned]
        ids, sizes, token_at = self._gather(self._places([w for own in units for w in own]))
        starts = token_at[np.concatenate([[0], np.cumsum([len(u) for u in units], dtype=np.int64)])]
        # Each text's alignment has one entry more than its normalised bytes, that of its end.
        where = np.concatenate([w for _, w in aligned]) if aligned else np.zeros(0, np.int64)
        ends = np.cumsum(sizes, dtype=np.int64) + np.repeat(np.arange(len(texts)), np.diff(starts))
        return ids, where[ends - sizes].astype(np.int32), where[ends].astype(np.int32), starts

    def _places(self, words: list[str]) -> np.ndarray:
        """The place of every word in the tables; new ones are merged and added."""
        known = self.memo
        found = list(map(known.get, words))
        if None not in found:
            return np.array(found, np.int64)
        fresh = list(dict.fromkeys(w for w, k in zip(words, found, strict=True) if k is None))
        if self.batched:
            fresh.sort(key=len)  # long words, of which each merges by itself, come last
            short = next((k for k, w in enumerate(fresh) if len(w) > self.WORD), len(fresh))
        else:
            short = 0
        parts = [self._merge_words(fresh[:short])] if short else []
        parts += [(np.array(i, np.int32), np.array(z, np.int32), np.array([len(i)])) for i, z in map(self._ids, fresh[short:])]
        new_ids, new_sizes, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        n, m = self.filled
        total = len(new_ids)
        ids, sizes, starts = (_room(t, k) for t, k in zip(self.table, (n + total, n + total, m + len(fresh)), strict=True))
        ids[n : n + total], sizes[n : n + total] = new_ids, new_sizes
        starts[m : m + len(fresh)] = n + np.cumsum(count)
        self.table, self.filled = (ids, sizes, starts), (n + total, m + len(fresh))
        now = dict(zip(fresh, range(m - 1, m - 1 + len(fresh)), strict=True))
        places = [now[w] if k is None else k for w, k in zip(words, found, strict=True)]
        known.update((w, k) for w, k in now.items() if len(w) <= self.WORD)
        return np.array(places, np.int64)

    def _gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and normalised bytes of all pieces, and where each word's start (one more than words)."""
        ids, sizes, starts = self.table
        count = starts[words + 1] - starts[words]
        token_at = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        at = np.arange(token_at[-1]) + np.repeat(starts[words] - token_at[:-1], count)
        return ids[at], sizes[at], token_at

    # Decoding

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: space marks become spaces, one leading space goes, byte pieces join up."""
        surface = self.surface
        raw = b"".join(map(surface.__getitem__, ids))
        lead = next((i for i in ids if self.kinds[i] != CONTROL), None)
        if (self.dummy_prefix or self.squeeze) and lead is not None and self.pieces[lead].startswith(SPACE):
            raw = raw.lstrip(b" ") if self.squeeze else raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_slowly(ids)

    def _decode_slowly(self, ids: list[int]) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                lead = run[at]
                size = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
                try:
                    out.append(bytes(run[at : at + size]).decode())
                    at += size
                except UnicodeDecodeError:
                    out.append("�")
                    at += 1
            run.clear()

        first = True
        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.surface[i]
                first = False
                continue
            flush()
            piece = self.surface[i].decode()
            if self.kinds[i] != CONTROL:
                if first and (self.dummy_prefix or self.squeeze) and self.pieces[i].startswith(SPACE):
                    piece = piece.lstrip(" ") if self.squeeze else piece[1:]
                first = False
            out.append(piece)
        flush()
        return "".join(out)


_LOADED: dict[str, Codec] = {}


def _room(table: np.ndarray, need: int) -> np.ndarray:
    return table if need <= len(table) else np.concatenate([table, np.zeros(max(len(table), need - len(table)), table.dtype)])


def codec(path: str) -> Codec:
    """The model at ``path``, loaded once in each process."""
    if path not in _LOADED:
        _LOADED[path] = Codec.load(path)
    return _LOADED[path]


def encode_documents(
    docs: DataFrame, model: str, text: str = "text", id: str = "doc_id", slice_bytes: int = 1_500_000, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Encode every text and decode it again.

    Returns ``id`` and ids array<int>, begins array<int>, ends array<int> (the source bytes of each piece) and decoded
    string, a row for each input row. A null text counts as empty and has no pieces; other columns of ``docs`` do not
    take part but those in ``keep``, which follow ``id``. Rows are worked on in slices of about ``slice_bytes`` bytes, which
    bounds memory; a longer text is a slice of its own. No shuffle.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    ship(docs.sparkSession)
    picked = docs.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("__text"), *keep)
    schema = T.StructType(
        [
            docs.schema[id],
            *(docs.schema[k] for k in keep),
            *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("ids", "begins", "ends")),
            T.StructField("decoded", T.StringType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = codec(model)
        for batch in batches:
            lens = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                end, size = at, 0
                while end < batch.num_rows and (end == at or size + lens[end] <= slice_bytes):
                    size += lens[end]
                    end += 1
                texts = batch.column(1).slice(at, end - at).to_pylist()
                ids, begins, ends, where = me.encode_many(texts)
                listed = ids.tolist()
                decoded = [me.decode(listed[a:b]) for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
                offsets = pa.array(where, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(at, end - at) for k in (0, *range(2, 2 + len(keep)))), *lists, pa.array(decoded, pa.string())],
                    names=schema.names,
                )
                at = end

    return picked.mapInArrow(released(work, lambda: codec(model)._forget()), schema)

"""Structure of many JSON texts at once, from the Arrow buffer that holds them.

``Scan`` indexes the structural characters of a whole batch with array operations: escapes,
quotes, brackets, commas and colons outside strings, each with its row, its depth and its
enclosing container. Members and elements are then found by parent-index arrays; nothing loops
over rows. Rows are taken to be valid JSON objects; an invalid row yields meaningless entries of
its own but never touches another row.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

#: Classes of the structural characters.
OPEN_OBJECT, OPEN_LIST, CLOSE_OBJECT, CLOSE_LIST, COMMA, COLON = 1, 2, 3, 4, 5, 6
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in "{[}],:"]] = [1, 2, 3, 4, 5, 6]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
#: White-space steps taken by plain loops before an index of all other bytes is built.
_SHORT_RUN = 4


class Scan:
    """Structural index of a string array. Containers are named by their opener's place in
    ``at`` (byte positions of the structural characters)."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(texts) else np.zeros(0, np.uint8)
        self.off = off - off[0] if len(off) else np.zeros(1, np.int64)
        self.data = np.append(data, np.uint8(0))
        self.rows = len(texts)
        size = len(data)
        escaped, self.slashes = self._escaped(size)
        quotes = np.flatnonzero(data == 34)
        if escaped is not None:
            quotes = quotes[~escaped[quotes]]
        self.quotes = quotes
        kinds = _CLASS[data]
        at = np.flatnonzero(kinds)
        row = np.repeat(np.arange(self.rows), np.diff(np.searchsorted(at, self.off)))
        before = np.searchsorted(quotes, self.off)
        outside = ((np.searchsorted(quotes, at) - before[row]) & 1) == 0
        self.at, self.row = at[outside], row[outside]
        self.kind = kinds[self.at]
        self._nest()
        self._solid = None

    def _escaped(self, size: int):
        slashes = np.flatnonzero(self.data[:size] == 92)
        if not len(slashes):
            return None, slashes
        first = np.zeros(size + 1, bool)
        first[self.off] = True
        starts = np.ones(len(slashes), bool)
        starts[1:] = (slashes[1:] != slashes[:-1] + 1) | first[slashes[1:]]
        n = np.arange(len(slashes))
        after = slashes[(n - np.maximum.accumulate(np.where(starts, n, 0))) % 2 == 0] + 1
        escaped = np.zeros(size + 1, bool)
        escaped[after[~first[after]]] = True
        return escaped[:size], slashes

    def _nest(self):
        opens, closes = self.kind <= OPEN_LIST, (self.kind == CLOSE_OBJECT) | (self.kind == CLOSE_LIST)
        level = np.cumsum(opens.astype(np.int64) - closes)
        starts = np.searchsorted(self.at, self.off)
        base = np.concatenate([[0], level])[starts[:-1]]
        depth = level - base[self.row] + closes
        order = np.argsort(depth.astype(np.int32), kind="stable")
        n = np.arange(len(order))
        last_open = np.maximum.accumulate(np.where(opens[order], n, 0)) if len(n) else n
        holder = np.full(len(order), -1)
        holder[order] = order[last_open]
        if len(n):
            wrong = (self.row[holder] != self.row) | (depth[holder] != depth) | ~opens[holder]
            holder[wrong] = -1
        self.holder = holder
        self.close = np.full(len(order), -1)
        ends = np.flatnonzero(closes & (holder >= 0))
        self.close[holder[ends]] = ends
        some = starts[:-1] < starts[1:]
        heads = starts[:-1][some]
        self.roots = heads[self.kind[heads] == OPEN_OBJECT]
        self.commas = np.flatnonzero((self.kind == COMMA) & (holder >= 0))
        self.colons = np.flatnonzero((self.kind == COLON) & (holder >= 0))
        ends = np.searchsorted(self.quotes, self.at[self.colons])
        self.colons, ends = self.colons[ends >= 2], ends[ends >= 2]
        self.key_from, self.key_to = self.quotes[ends - 2] + 1, self.quotes[ends - 1]
        self._named: dict[str, np.ndarray] = {}

    def _skip(self, p: np.ndarray) -> np.ndarray:
        p = np.minimum(p, len(self.data) - 1)
        for _ in range(_SHORT_RUN):
            blank = _SPACE[self.data[p]]
            if not blank.any():
                return p
            p = p + blank
        if self._solid is None:
            self._solid = np.flatnonzero(~_SPACE[self.data])  # the closing 0 is one
        return self._solid[np.searchsorted(self._solid, p)]

    def _colons_of(self, name: str) -> np.ndarray:
        """Colons whose key is the name, also where the key is written with escapes."""
        if name not in self._named:
            want = np.frombuffer(name.encode(), np.uint8)
            hit = np.flatnonzero(self.key_to - self.key_from == len(want))
            for k, byte in enumerate(want):
                hit = hit[self.data[self.key_from[hit] + k] == byte]
            if len(self.slashes):
                odd = np.flatnonzero(np.searchsorted(self.slashes, self.key_from) != np.searchsorted(self.slashes, self.key_to))
                keys = self._unescape(self.spans(self.key_from[odd], self.key_to[odd])).to_pylist()
                hit = np.sort(np.concatenate([hit, odd[[k == name for k in keys]] if len(odd) else odd]))
            self._named[name] = self.colons[hit]
        return self._named[name]

    def members(self, objects: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(parent, value): the places in ``objects`` whose object has the member, and where its
        value begins. Of repeated keys the last counts."""
        inverse = np.full(len(self.at) + 1, -1)
        inverse[objects] = np.arange(len(objects))
        colons = self._colons_of(name)
        parent = inverse[self.holder[colons]]
        found = np.full(len(objects), -1)
        found[parent[parent >= 0]] = colons[parent >= 0]
        have = np.flatnonzero(found >= 0)
        return have, self._skip(self.at[found[have]] + 1)

    def elements(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(parent, pos, value): the elements of the lists, in order."""
        inverse = np.full(len(self.at) + 1, -1)
        inverse[lists] = np.arange(len(lists))
        parent = inverse[self.holder[self.commas]]
        inner = parent >= 0
        parent = np.concatenate([np.arange(len(lists)), parent[inner]])
        begin = np.concatenate([self.at[lists], self.at[self.commas[inner]]])
        order = np.lexsort((begin, parent))
        parent, value = parent[order], self._skip(begin[order] + 1)
        n = np.arange(len(parent))
        pos = n - np.searchsorted(parent, np.arange(len(lists)))[parent] if len(n) else n
        real = self.data[value] != ord("]")
        return parent[real], pos[real], value[real]

    def rest(self, objects: np.ndarray, carried: dict[str, np.ndarray]) -> pa.Array:
        """The objects as JSON texts without the members that are carried elsewhere (by name, for
        which objects); null where no member is left. The members are spans of the source."""
        import pyarrow.compute as pc  # noqa: PLC0415

        if not len(objects):
            return pa.nulls(0, pa.large_string())
        inverse = np.full(len(self.at) + 1, -1)
        inverse[objects] = np.arange(len(objects))
        owner = inverse[self.holder[self.colons]]
        keep = owner >= 0
        for name, mask in carried.items():
            places = np.searchsorted(self.colons, self._colons_of(name))
            places = places[owner[places] >= 0]
            keep[places[mask[owner[places]]]] = False
        k = np.flatnonzero(keep)
        k = k[np.argsort(owner[k], kind="stable")]
        ends = np.flatnonzero(((self.kind == COMMA) | (self.kind == CLOSE_OBJECT) | (self.kind == CLOSE_LIST)) & (self.holder >= 0))
        ends = ends[inverse[self.holder[ends]] >= 0]
        size = len(self.at) + 1
        key = np.sort(inverse[self.holder[ends]] * size + ends)
        begin, after = self.key_from[k] - 1, np.searchsorted(key, owner[k] * size + self.colons[k])
        found = key[np.minimum(after, len(key) - 1)] if len(key) else np.full(len(k), -1)
        end = np.where((after < len(key)) & (found // size == owner[k]), self.at[found % size if len(key) else np.zeros(len(k), np.int64)], begin)
        n = np.bincount(owner[k], minlength=len(objects))
        if not len(k):
            return pa.nulls(len(objects), pa.large_string())
        fence = np.concatenate([[0], np.cumsum(n)])
        head, tail = np.full(len(k), ","), np.full(len(k), "", "U1")
        head[fence[:-1][n > 0]] = "{"
        tail[fence[1:][n > 0] - 1] = "}"
        parts = pc.binary_join_element_wise(pa.array(head, pa.large_string()), self.spans(begin, end), pa.array(tail, pa.large_string()), pa.scalar("", pa.large_string()))
        off = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(k) + 1]
        text = pa.Array.from_buffers(pa.large_string(), len(objects), [None, pa.py_buffer(np.ascontiguousarray(off[fence])), parts.buffers()[2]])
        return pc.if_else(pa.array(n > 0), text, None)

    def container(self, value: np.ndarray) -> np.ndarray:
        """Openers at the byte positions (which must hold one); -1 where there is none."""
        k = np.searchsorted(self.at, value)
        k = np.minimum(k, max(len(self.at) - 1, 0))
        return np.where(self.at[k] == value, k, -1) if len(self.at) else np.full(len(value), -1)

    def byte(self, value: np.ndarray) -> np.ndarray:
        return self.data[value]

    def spans(self, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """The texts between byte positions, gathered in one take."""
        size = np.maximum(end - begin, 0)
        off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        take = np.repeat(begin - off[:-1], size) + np.arange(off[-1])
        return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(self.data[take]))])

    @staticmethod
    def _unescape(texts: pa.Array) -> pa.Array:
        """JSON string contents as text; only those holding a backslash are decoded one by one."""
        import pyarrow.compute as pc  # noqa: PLC0415

        odd = pc.indices_nonzero(pc.match_substring(texts, "\\")).to_numpy()
        if not len(odd):
            return texts
        out = texts.to_numpy(zero_copy_only=False).astype(object)
        for i in odd:
            try:
                out[i] = json.loads(f'"{out[i]}"', strict=False).encode("utf-8", "replace").decode()
            except ValueError:
                out[i] = None
        return pa.array(out, pa.large_string())

    def strings(self, value: np.ndarray) -> pa.Array:
        """The strings that begin at the byte positions of their opening quotes."""
        k = np.minimum(np.searchsorted(self.quotes, value) + 1, max(len(self.quotes) - 1, 0))
        return self._unescape(self.spans(value + 1, self.quotes[k] if len(self.quotes) else value))

    def scalars(self, value: np.ndarray) -> pa.Array:
        """The numbers or literals that begin at the byte positions."""
        k = np.minimum(np.searchsorted(self.at, value), max(len(self.at) - 1, 0))
        import pyarrow.compute as pc  # noqa: PLC0415

        return pc.utf8_trim(self.spans(value, self.at[k] if len(self.at) else value), " \t\n\r")

    def values(self, value: np.ndarray) -> pa.Array:
        """The JSON texts of the values, of any kind, that begin at the byte positions."""
        out = self.scalars(value)
        at = np.flatnonzero(np.isin(self.byte(value), (34, 91, 123)))
        if not len(at):
            return out
        quoted = self.byte(value[at]) == 34
        ends = np.zeros(len(at), np.int64)
        ends[quoted] = self.quotes[np.minimum(np.searchsorted(self.quotes, value[at][quoted]) + 1, len(self.quotes) - 1)]
        if not quoted.all():
            close = self.close[self.container(value[at][~quoted])]
            ends[~quoted] = np.where(close >= 0, self.at[close], value[at][~quoted] - 1)  # an unclosed one is no text
        where = np.full(len(value), -1)
        where[at] = np.arange(len(at))
        spans = self.spans(value[at], ends + 1)
        import pyarrow.compute as pc  # noqa: PLC0415

        return pc.coalesce(spans.take(pa.array(where, mask=where < 0)), out)

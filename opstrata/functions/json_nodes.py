"""JSON texts of an Arrow column turned into node tables by array kernels, a whole column at a time.

No text is parsed row by row. The column's byte buffer is scanned once for quotes, structure and literals; every token then gets its
depth (a running sum), its enclosing container (a search in the sorted openings of its depth), its place in an array (a difference of
comma ranks, the list offset) and its field name. The grammar is checked on neighbouring tokens. Paths are made a level at a time, by taking
the parents' paths by parent index and joining the last step, so the cost follows the number of containers asked for.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OBJECT, ARRAY, END_OBJECT, END_ARRAY, COLON, COMMA, STRING, LITERAL = range(1, 9)
_CODE = np.zeros(256, np.uint8)
for _c, _k in zip(b"{[}]:,", range(1, 7), strict=True):
    _CODE[_c] = _k
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r")] = True
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_LITERALS = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"

NODES = pa.schema([("row", pa.int64()), ("path", pa.string()), ("parent_path", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("value", pa.string())])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another and where each begins; null is empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow string column."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))).cast(pa.string())


def _unescape(raw: pa.Array) -> pa.Array:
    """Strings as written between quotes to what they denote; only those with a backslash are decoded."""
    hit = np.flatnonzero(pc.match_substring(raw, "\\").to_numpy(zero_copy_only=False))
    if not len(hit):
        return raw
    out = raw.to_pylist()
    for i in hit:
        out[i] = json.loads(f'"{out[i]}"', strict=False).encode("utf-8", "backslashreplace").decode()
    return pa.array(out, pa.string())


class Tokens:
    """The tokens of a column of JSON texts; ``ok`` tells which texts are readable (RFC 8259, one value each)."""

    def __init__(self, texts: pa.Array):
        data, start = _bytes(texts)
        n, size = len(texts), len(data)
        self.data, self.start = data, start
        ok = np.diff(start) > 0
        row_of = lambda at: np.searchsorted(start, at, "right") - 1

        # escapes: a backslash at an even place of its run escapes the byte that follows
        slash = np.flatnonzero(data == 92)
        escaped = np.zeros(0, np.int64)
        if len(slash):
            fresh = np.ones(len(slash), bool)
            fresh[1:] = (np.diff(slash) > 1) | (row_of(slash[1:]) != row_of(slash[:-1]))
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(slash)), 0))
            active = slash[(np.arange(len(slash)) - first) % 2 == 0]
            escaped = active + 1
            last = escaped >= start[row_of(active) + 1]
            ok[row_of(active[last])] = False
            escaped, active = escaped[~last], active[~last]
            ok[row_of(active[~_ESCAPED[data[escaped]]])] = False
            u = escaped[data[escaped] == 117]
            for k in range(1, 5):
                within = u + k < start[row_of(u) + 1]
                ok[row_of(u[~within])] = False
                ok[row_of(u[within][~_HEX[data[u[within] + k]]])] = False
        quote = data == 34
        quote[escaped[data[escaped] == 34]] = False
        quotes = np.flatnonzero(quote)
        q_row = row_of(quotes)
        begin = np.searchsorted(quotes, start[:-1])
        closing = (np.arange(len(quotes)) - begin[q_row]) % 2 == 1
        count = np.bincount(q_row, minlength=n) if len(quotes) else np.zeros(n, np.int64)
        ok &= count % 2 == 0
        # byte is within a string, quotes included
        step = np.zeros(size + 1, np.int8)
        step[quotes[~closing]] += 1
        step[quotes[closing] + 1] -= 1
        odd = count % 2 == 1
        if odd.any():
            step[start[1:][odd]] -= 1
        inside = np.cumsum(step[:size], dtype=np.int8) > 0
        control = np.flatnonzero(inside & (data < 32))
        ok[row_of(control)] = False

        kind = np.where(inside, np.uint8(0), _CODE[data])
        word = ~inside & (kind == 0) & ~_SPACE[data]
        edge = np.zeros(size + 1, bool)
        edge[start[:-1][start[:-1] < size]] = True
        before = np.zeros(size, bool)
        before[1:] = word[:-1]
        word_start = word & (~before | edge[:size])
        kind[word_start] = LITERAL
        kind[quotes[~closing]] = STRING
        at = np.flatnonzero(kind)
        kind = kind[at]
        row = row_of(at)
        # where strings and literals end
        end = at + 1
        opening = quotes[~closing]
        partner = np.searchsorted(quotes, at[kind == STRING]) + 1
        end[kind == STRING] = np.where(partner < len(quotes), quotes[np.minimum(partner, max(len(quotes) - 1, 0))] + 1, size) if len(opening) else 0
        letters = np.flatnonzero(word)
        if len(letters):
            w_first = np.flatnonzero(word_start[letters])
            lengths = np.diff(np.append(w_first, len(letters)))
            end[kind == LITERAL] = at[kind == LITERAL] + lengths
            values = _gather(data, at[kind == LITERAL], lengths) if ok.all() else None
            if values is None:
                keep = ok[row[kind == LITERAL]]
                good = np.zeros(len(keep), bool)
                good[keep] = self._literals(_gather(data, at[kind == LITERAL][keep], lengths[keep]))
            else:
                good = self._literals(values)
            ok[row[kind == LITERAL][~good]] = False

        # depth: of the container that a token stands in; a closing token stands in the container it closes
        opens, closes = kind <= ARRAY, (kind == END_OBJECT) | (kind == END_ARRAY)
        run = np.cumsum(opens.astype(np.int64) - closes)
        first_tok = np.searchsorted(at, start[:-1])
        has = np.searchsorted(at, start[1:]) > first_tok
        ok &= has
        base = np.where(first_tok > 0, run[np.maximum(first_tok - 1, 0)], 0) if len(run) else np.zeros(n, np.int64)
        after = run - base[row]
        level = after - opens + closes
        ok[row[(after < 0) | (level < 0)]] = False
        last_tok = np.searchsorted(at, start[1:]) - 1
        ok[has] &= after[last_tok[has]] == 0
        keep = ok[row]
        at, end, kind, row, level = at[keep], end[keep], kind[keep], row[keep], level[keep]
        m = len(at)
        idx = np.arange(m)
        opens = kind <= ARRAY
        big = m + 1
        open_key = (level[opens] + 1) * big + idx[opens]
        order = np.argsort(open_key)
        open_key, open_idx = open_key[order], idx[opens][order]
        parent = np.full(m, -1, np.int64)
        deep = level > 0
        if deep.any():
            parent[deep] = open_idx[np.searchsorted(open_key, level[deep] * big + idx[deep]) - 1]
        within = np.where(parent >= 0, kind[np.maximum(parent, 0)], 0) if m else np.zeros(0, np.uint8)
        # grammar: what may stand before a token, by the container it stands in
        first = np.ones(m, bool)
        first[1:] = row[1:] != row[:-1]
        p1 = np.zeros(m, np.uint8)
        p1[1:] = kind[:-1]
        p1[first] = 0
        value = (kind == STRING) | (kind == LITERAL) | opens
        key = (kind == STRING) & (within == OBJECT) & ((p1 == OBJECT) | (p1 == COMMA))
        was_key = np.zeros(m, bool)
        was_key[1:] = key[:-1]
        was_key[first] = False
        done = ((p1 == STRING) | (p1 == LITERAL) | (p1 == END_OBJECT) | (p1 == END_ARRAY)) & ~was_key
        good = np.select(
            [key, value & (within == OBJECT), value & (within == ARRAY), value & (within == 0), kind == COLON, kind == COMMA, kind == END_OBJECT, kind == END_ARRAY],
            [True, p1 == COLON, (p1 == ARRAY) | (p1 == COMMA), first, was_key & (within == OBJECT), done & (within > 0), (within == OBJECT) & ((p1 == OBJECT) | done), (within == ARRAY) & ((p1 == ARRAY) | done)],
            False,
        )
        ok[row[~good]] = False
        self.ok = ok
        self.at, self.end, self.kind, self.row, self.level, self.parent, self.within, self.key, self.value = at, end, kind, row, level, parent, within, key, value & ~key
        self.n, self._commas = n, None

    @staticmethod
    def _literals(values: pa.Array) -> np.ndarray:
        return pc.match_substring_regex(values, _LITERALS).to_numpy(zero_copy_only=False)

    def ordinals(self, tokens: np.ndarray) -> np.ndarray:
        """The place of each token in its array, from 0: how many commas of that array precede it."""
        big = len(self.at) + 1
        if self._commas is None:
            comma = np.flatnonzero(self.kind == COMMA)
            self._commas = np.sort(self.level[comma] * big + comma)
        lv = self.level[tokens] * big
        return np.searchsorted(self._commas, lv + tokens) - np.searchsorted(self._commas, lv + self.parent[tokens])

    def names(self, tokens: np.ndarray) -> pa.Array:
        """The field names of values that stand in objects: two tokens before the value."""
        k = tokens - 2
        return _unescape(_gather(self.data, self.at[k] + 1, self.end[k] - self.at[k] - 2))


def _paths(t: Tokens, tokens: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Path, parent's path and ordinal (-1 in objects) of the given values and, on the way, of every container above them."""
    need = np.zeros(len(t.at), bool)
    need[tokens] = True
    up = tokens
    while (up := t.parent[up]).size:
        up = np.unique(up[up >= 0])
        up = up[~need[up]]  # what is needed has its parents on the way already
        need[up] = True
    need = np.flatnonzero(need)
    need = need[np.argsort(t.level[need], kind="stable")]
    cuts = np.searchsorted(t.level[need], np.arange(int(t.level[need[-1]]) + 2)) if len(need) else np.zeros(1, np.int64)
    place = np.full(len(t.at), -1, np.int64)
    ordinal = np.full(len(t.at), -1, np.int32)
    levels: list[pa.Array] = [pa.array([], pa.string())]
    above, begin = levels[0], 0  # the paths of the level above and the place of the first of them
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        here = need[a:b]
        if not begin and not a:
            new = pa.array([""] * len(here), pa.string())
        else:
            in_array = t.within[here] == ARRAY
            elements, fields = here[in_array], here[~in_array]
            ordinal[elements] = t.ordinals(elements)
            steps_a = pc.binary_join_element_wise(above.take(place[t.parent[elements]] - begin), "[", pa.array(ordinal[elements]).cast(pa.string()), "]", "")
            over = above.take(place[t.parent[fields]] - begin)
            steps_o = pc.binary_join_element_wise(over, pc.if_else(pc.equal(over, ""), "", "."), t.names(fields), "")
            here = np.concatenate([elements, fields])
            new = pa.concat_arrays([steps_a, steps_o])
        place[here] = a + np.arange(len(here))
        levels.append(new)
        above, begin = new, a
    made = pa.concat_arrays(levels)
    paths = made.take(place[tokens])
    parents = t.parent[tokens]
    above = made.take(pa.array(np.where(parents >= 0, place[np.maximum(parents, 0)], 0), mask=parents < 0)) if len(tokens) else pa.array([], pa.string())
    return paths, above, ordinal[tokens]


def nodes(texts: pa.Array, want: str = "objects") -> pa.Table:
    """The nodes of every readable text, by the columns of NODES; ``row`` is the text's place in the column.

    want: ``array_objects`` (objects that are elements of arrays), ``objects`` (all objects, the root with an empty path) or ``values``
    (strings and literals, as written or decoded). A text that is one JSON string is read as the document that the string holds, however often it is
    wrapped. Null, empty and unreadable texts give no rows. Half a surrogate pair stands as its escape.
    """
    row, out = None, []
    while True:  # once for all texts, then for those within strings
        t = Tokens(texts)
        part = _nodes(t, want)
        if row is not None:
            part = part.set_column(0, "row", pa.array(row[part["row"].to_numpy()], pa.int64()))
        out.append(part)
        root = np.flatnonzero((t.level == 0) & (t.kind == STRING) & t.ok[t.row])
        if not len(root):
            return pa.concat_tables(out)
        row = t.row[root] if row is None else row[t.row[root]]
        texts = _unescape(_gather(t.data, t.at[root] + 1, t.end[root] - t.at[root] - 2))


def _nodes(t: Tokens, want: str) -> pa.Table:
    """The nodes of tokens that aren't within strings."""
    if want == "array_objects":
        pick = t.value & (t.kind == OBJECT) & (t.within == ARRAY)
    elif want == "objects":
        pick = t.value & (t.kind == OBJECT)
    else:
        pick = t.value & (t.kind >= STRING) & (t.level > 0)
    tokens = np.flatnonzero(pick & t.ok[t.row])
    paths, above, ordinal = _paths(t, tokens)
    kinds = pa.array(np.array(["", "object", "array", "", "", "", "", "string", "literal"], object)[t.kind[tokens]], pa.string())
    if want == "values" and len(tokens):
        text = t.kind[tokens] == STRING
        raw = _gather(t.data, t.at[tokens] + text, t.end[tokens] - t.at[tokens] - 2 * text)
        value = pc.if_else(pa.array(text), _unescape(raw), raw) if text.any() else raw
    else:
        value = pa.nulls(len(tokens), pa.string())
    return pa.table([pa.array(t.row[tokens], pa.int64()), paths, above, pa.array(ordinal, mask=ordinal < 0), kinds, value], schema=NODES)

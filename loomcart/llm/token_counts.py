"""Exact token counts at every prefix of a text (byte-level BPE).

For each distinct pre-token a dynamic programme walks over its bytes and
stores, for every prefix, the last token of that prefix's encoding and the
number of tokens.  The last token is the only vocabulary entry ending there
that is compatible with the last token of the prefix before it: two tokens
are compatible if encoding their joined bytes gives just those two.  Counts of
texts, of any text prefix, and cuts to a token budget are then sums and
look-ups, without encoding anything again.

A prefix of a text may split differently from the whole: a run of white space
that is cut ends the text, and a cut contraction is a mark and a letter.  Both
are handled, so ``prefix_counts(text)[i]`` equals the number of tokens the
tokenizer gives for ``text[:i]``.

Defined cases: a null or empty text has 0 tokens; the special string of the
tokenizer counts as one token; a text without spaces is one pre-token of any
length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import in_slices

# Fixed by the tokenizer: how text is split before merging.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
         r"|\s+(?!\S)|\s+")


SEPARATOR = chr(0x100)  # no byte


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for the 256 bytes in vocabulary files:
    printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenCounter:
    """Prefix counts for one tokenizer file (byte-level BPE, ids in merge
    order)."""

    def __init__(self, path: str, table_words: int = 300_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.table_words = table_words
        self.specials = [t["content"] for t in spec["added_tokens"]]
        letter = _byte_letters()
        raw = {w: bytes(map(letter.__getitem__, w)) for w in spec["model"]["vocab"]
               if w not in self.specials}
        vocab = spec["model"]["vocab"]
        self.rank = {}                 # (left id, right id) -> order of the merge
        self.parts: dict[int, tuple[int, int, int]] = {}
        for order, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = order
            self.parts.setdefault(made, (left, right, order))
        # Tokens a text can contain: those whose own bytes encode to themselves.
        self.token = {raw[w]: i for w, i in vocab.items() if w in raw
                      and (len(raw[w]) == 1 or i in self.parts)}
        self.pre = regex.compile(SPLIT)
        self.by_special = regex.compile("|".join(map(regex.escape, self.specials))) \
            if self.specials else None
        self._spines: dict[int, tuple[list, list]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._words: dict[str, np.ndarray] = {}
        self._segments: dict[str, int] = {}
        self.token = {b: i for b, i in self.token.items() if self._whole(b, i)}
        import ahocorasick

        self.finder = ahocorasick.Automaton()
        for b, i in self.token.items():
            self.finder.add_word(b.decode("latin-1"), (i, len(b)))
        self.finder.make_automaton()

    def _whole(self, raw: bytes, token: int) -> bool:
        """Whether the token's bytes encode to the token."""
        if len(raw) == 1:
            return True
        left, right, _ = self.parts[token]
        return self.fits(left, right, self.parts[token][2])

    def _spine(self, token: int) -> tuple[list, list]:
        """The symbols at the left and at the right edge of a token while it
        is being merged, first byte to whole, with the order of the merge that
        replaces each."""
        if token not in self._spines:
            both = []
            for side in (0, 1):
                chain, t, until = [], token, np.inf
                while True:
                    chain.append((t, until))
                    if t not in self.parts:
                        break
                    until = self.parts[t][2]
                    t = self.parts[t][side]
                both.append(chain[::-1])
            self._spines[token] = tuple(both)
        return self._spines[token]

    def fits(self, a: int, b: int, before: float = np.inf) -> bool:
        """True if no merge crosses the border of tokens a and b (earlier than
        the merge number ``before``)."""
        left, right = self._spine(a)[1], self._spine(b)[0]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            cross = self.rank.get((x, y), np.inf)
            # Equal numbers: the leftmost place merges first.
            if cross < before and cross < x_until and cross <= y_until:
                return False
            if x_until == np.inf and y_until == np.inf:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def word_counts(self, words: list[str]) -> list[np.ndarray]:
        """For each pre-token the token count of each byte prefix (0 to all)."""
        raw = [w.encode().decode("latin-1") for w in words]
        joined = SEPARATOR.join(raw)
        last = [-1] * (len(joined) + 1)       # last token of the prefix before a place
        count = [0] * (len(joined) + 1)
        known, fits = self._fits, self.fits
        starts, at = [], 0
        for w in raw:
            starts.append(at)
            at += len(w) + 1
        done = -1
        for end, (t, size) in self.finder.iter(joined):    # longest first at each place
            if end == done:
                continue
            start = end + 1 - size
            before = last[start]
            if before >= 0:
                pair = before * 65536 + t
                ok = known.get(pair)
                if ok is None:
                    if len(known) > 1_000_000:
                        known.clear()
                    ok = known[pair] = fits(before, t)
                if not ok:
                    continue
            last[end + 1] = t
            count[end + 1] = count[start] + 1
            done = end
        flat = np.array(count, np.int32)
        return [flat[a:a + len(w) + 1] for a, w in zip(starts, raw)]

    def _counts(self, word: str) -> np.ndarray:
        found = self._words.get(word)
        if found is None:
            if len(self._words) >= self.table_words:
                self._words.clear()
            found = self._words[word] = self.word_counts([word])[0].copy()
        return found

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of the text between special strings, and those strings."""
        at = 0
        if self.by_special is not None and any(s in text for s in self.specials):
            for m in self.by_special.finditer(text):
                yield text[at:m.start()], False
                yield m.group(), True
                at = m.end()
        yield text[at:], False

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        total, table, counts = 0, self._words, self._counts
        for part, special in self.pieces(text):
            if special:
                total += 1
                continue
            for w in self.pre.findall(part):
                found = table.get(w)
                total += int((counts(w) if found is None else found)[-1])
        return total

    def _segment_counts(self, segments: list[str]) -> dict[str, int]:
        """Tokens of a space and the text up to the next space; -1 if white
        space stands at either end, where the split needs the neighbours."""
        own = [[] if not s or s[0].isspace() or s[-1].isspace() else self.pre.findall(" " + s)
               for s in segments]
        words = list(dict.fromkeys(w for o in own for w in o))
        size = {w: int(c[-1]) for w, c in zip(words, self.word_counts(words))}
        return {s: sum(map(size.__getitem__, o)) if o else -1 for s, o in zip(segments, own)}

    def count_texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each whole text (no nulls).  A single space between two
        other characters always starts a pre-token, so texts are cut there and
        each distinct segment is counted once; texts with other white space
        around a space, or with special strings, are split as a whole."""
        n = len(texts)
        split = pc.split_pattern(texts, " ")
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)).astype(np.int64)
        starts = np.r_[0, ends[:-1]].astype(np.int64) if n else np.zeros(0, np.int64)
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        table = self._segments
        if len(table) >= self.table_words:
            table.clear()
        segments = coded.dictionary.to_pylist()
        table |= self._segment_counts([s for s in segments if s not in table])
        found = list(map(table.__getitem__, segments))
        each = np.array(found, np.int64)[code] if found else np.zeros(0, np.int64)
        total = np.r_[0, np.cumsum(each)]
        odd = np.r_[0, np.cumsum(each < 0)]
        out = total[ends] - total[starts]
        whole = odd[ends] > odd[starts]
        for s in self.specials:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        firsts = pc.list_element(split, 0).to_pylist()
        for d in range(n):
            if whole[d]:
                out[d] = self.count(texts[d].as_py())
            else:                                     # no space before the first segment
                out[d] += self._first(firsts[d]) - each[starts[d]]
        return out

    def _first(self, segment: str) -> int:
        counts = self._counts
        return sum(int(counts(w)[-1]) for w in self.pre.findall(segment))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for every i from 0 to the number of characters."""
        out = np.zeros(len(text) + 1, np.int64)
        at = total = 0
        for part, special in self.pieces(text):
            if special:
                # A cut special string is ordinary text after what precedes it.
                for k in range(1, len(part)):
                    out[at + k] = self.count(text[:at + k])
                at, total = at + len(part), total + 1
                out[at] = total
                continue
            words = self.pre.findall(part)
            i = 0
            while i < len(words):
                # White space up to the next word is one run: a cut in it ends the text.
                j, run = i, ""
                while j < len(words) and words[j].isspace():
                    run += words[j]
                    j += 1
                nxt = words[j] if j < len(words) else ""
                lead = nxt[:1] if nxt[:1].isspace() else ""
                if run or lead:
                    whole = self._chars(run + lead)
                    for k in range(1, len(run) + len(lead) + 1):
                        out[at + k] = total + whole[k]
                    for w in words[i:j]:
                        total += int(self._counts(w)[-1])
                    at += len(run)
                if nxt:
                    own = self._chars(nxt)
                    if nxt[0] == "'" and len(nxt) > 1 and nxt[1].isalpha():
                        own = np.array([0, 1, *([2] * (len(nxt) - 2)), own[-1]])
                    for k in range(1 + len(lead), len(nxt) + 1):
                        out[at + k] = total + own[k]
                    total += int(own[-1])
                    at += len(nxt)
                i = j + 1
            out[at] = total if at and part else out[at]
        return out

    def _chars(self, word: str) -> np.ndarray:
        """Counts at character prefixes of a pre-token."""
        ends = np.cumsum([0, *[len(c.encode()) for c in word]])
        return self._counts(word)[ends]

    def cut(self, text: str, budget: int) -> int:
        """Largest number of leading characters whose tokens fit the budget."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter per Python worker and tokenizer file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_documents(docs: DataFrame, path: str, id_col: str = "doc_id",
                    text_col: str = "text", budgets: tuple[int, ...] = (),
                    with_prefixes: bool = False, slice_bytes: int = 3_000_000) -> DataFrame:
    """One row per document: ``id_col``, n_bytes, n_tokens; for each budget b
    a column chars_b (leading characters that fit b tokens); if asked for,
    prefix_tokens (count at every character prefix)."""
    src = docs.select(docs[id_col].alias("k"), docs[text_col].alias("t"))
    key_type = src.schema["k"].dataType.simpleString()
    cuts = [f"chars_{b}" for b in budgets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            keys, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            sizes = pc.binary_length(texts)
            for lo, hi in in_slices(sizes.to_pylist(), slice_bytes):
                part = texts.slice(lo, hi - lo)
                cols = [keys.slice(lo, hi - lo), sizes.slice(lo, hi - lo).cast(pa.int64()),
                        pa.array(c.count_texts(part), pa.int64())]
                if budgets or with_prefixes:
                    prefixes = [c.prefix_counts(t) for t in part.to_pylist()]
                    cols += [pa.array([int(np.flatnonzero(p <= b)[-1]) for p in prefixes], pa.int64())
                             for b in budgets]
                    if with_prefixes:
                        cols.append(pa.array(prefixes, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(
                    cols, names=["k", "n_bytes", "n_tokens", *cuts, *(["prefix_tokens"] * with_prefixes)])

    schema = (f"k {key_type}, n_bytes long, n_tokens long"
              + "".join(f", {c} long" for c in cuts)
              + ", prefix_tokens array<long>" * with_prefixes)
    return src.mapInArrow(run, schema).withColumnRenamed("k", id_col)

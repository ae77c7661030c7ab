"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A text is split before every space mark into words, since no piece of the
vocabulary runs from a letter into a space mark.  The distinct words of a
slice of texts lie in flat numpy arrays of symbols; each round finds the best
pair rank of every word (a segmented minimum), merges its leftmost
non-overlapping occurrences at once, and compacts the arrays, until no word
has a pair left.  Words already encoded are kept in a table of bounded size.

Merging all occurrences of a pair at once equals the library's one-by-one
order unless a better ranked piece starts or ends with the merged piece; for
such pieces only the leftmost occurrence is merged per round.  Pieces made of
space marks only share one rank in this kind of vocabulary and are applied
after all others, so runs of spaces are cut by a table of run lengths.

Defined cases: a null or empty text gives the end id alone and decodes to the
empty text; characters outside the vocabulary become byte pieces; a text
without spaces is one word of any length.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import in_slices

MARK = "▁"  # stands for a space inside pieces


class PieceCodec:
    """Encoder and decoder for one model file."""

    def __init__(self, model_path: str, table_words: int = 400_000, long_word: int = 1000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.size = sp.get_piece_size()
        self.end_id = sp.eos_id()
        self.table_words = table_words
        self.long_word = long_word           # characters; longer words merge from a heap
        self.decimal = [str(i) for i in range(self.size)].__getitem__
        pieces = [sp.id_to_piece(i) for i in range(self.size)]
        self._bytes_of: list[bytes] = []
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.byte_id = np.full(256, sp.unk_id(), np.int64)
        self.byte_value = np.full(self.size, -1, np.int64)
        normal: dict[str, int] = {}
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                value = int(p[3:5], 16)
                self.byte_id[value], self.byte_value[i] = i, value
                self._bytes_of.append(bytes([value]))
            elif sp.is_control(i):
                self._bytes_of.append(b"")
            elif sp.is_unknown(i):
                self._bytes_of.append(" ⁇ ".encode())
            else:
                if not sp.is_unused(i):
                    normal[p] = i
                self._bytes_of.append(p.replace(MARK, " ").encode())
        for p in normal:
            if MARK in p[1:] and p.strip(MARK):
                raise ValueError("pieces that cross a space mark are not supported")
        # Ranks: 0 is the best score; equal scores share a rank.
        scores = {p: sp.get_score(i) for p, i in normal.items() if len(p) > 1}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        runs = {p for p in scores if not p.strip(MARK)}
        self._runs = {len(p): normal[p] for p in runs}
        rank = {p: order[s] for p, s in scores.items() if p not in runs}
        self.none = np.int64(len(order) + 1)
        # Symbols: piece ids; a character without a piece is size + code point.
        self.char_id = np.arange(0x110000, dtype=np.int64) + self.size
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        keys, to, ranks, shy = [], [], [], np.zeros(self.size, bool)
        for p, r in rank.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                left, right = self._symbol(a, normal), self._symbol(b, normal)
                if left is not None and right is not None:
                    keys.append(left * (self.size + 0x110000) + right)
                    to.append(normal[p])
                    ranks.append(r)
                for part in (a, b):
                    if part in rank and r <= rank[part]:
                        shy[normal[part]] = True
        by = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[by]
        self.to = np.array(to, np.int64)[by]
        self.ranks = np.array(ranks, np.int64)[by]
        self.shy = shy
        self._run_cuts: dict[int, list[int]] = {}
        self._pair_of: dict[int, tuple[int, int]] | None = None
        lens = np.array([len(b) for b in self._bytes_of], np.int64)
        self._piece_flat = np.frombuffer(b"".join(self._bytes_of), np.uint8)
        self._piece_start = np.concatenate([[0], np.cumsum(lens)])
        self._reset()

    def _symbol(self, s: str, normal: dict[str, int]) -> int | None:
        if s in normal:
            return normal[s]
        return int(self.char_id[ord(s)]) if len(s) == 1 else None

    def _reset(self) -> None:
        self._index: dict[str, int] = {}
        self._flat = np.zeros(1 << 16, np.int32)
        self._start = np.zeros(1, np.int64)

    # -- words ---------------------------------------------------------------

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair of symbols."""
        key = left * (self.size + 0x110000) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], self.none), self.to[at]

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of each word (words as written, mark included), flat, and
        the number per word.  No word may be empty."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self.char_id[points]
        word = np.repeat(np.arange(len(words)), n)
        done_sym, done_word = [], []
        for i in np.flatnonzero(n > self.long_word).tolist():
            done_sym.append(self._merge_long(sym[word == i]))
            done_word.append(np.full(len(done_sym[-1]), i))
        if done_sym:
            short = (n <= self.long_word)[word]
            sym, word = sym[short], word[short]
        rank = np.full(len(sym), self.none)          # of the pair (i, i + 1)
        to = np.zeros(len(sym), np.int64)
        pair = np.flatnonzero(word[1:] == word[:-1])
        rank[pair], to[pair] = self._pairs(sym[pair], sym[pair + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(sym)])
            best = np.minimum.reduceat(rank, first)
            live = best < self.none
            if not live.all():                        # compaction: finished words leave
                keep = np.repeat(live, size)
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
                best, size = best[live], size[live]
                if not len(sym):
                    break
                first = np.cumsum(size) - size
            hit = rank == np.repeat(best, size)
            at = np.flatnonzero(hit)
            # Overlaps: of a run of neighbouring hits every second one counts.
            new_run = np.r_[True, np.diff(at) > 1]
            run_at = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - run_at) % 2 == 0
            shy = self.shy[to[at]]
            if shy.any():                             # leftmost occurrence only
                w = word[at]
                leading = np.r_[True, w[1:] != w[:-1]]
                take &= leading | ~shy
            at = at[take]
            sym[at] = to[at]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            keep = ~gone
            new_at = np.cumsum(keep) - 1              # places after compaction
            at = new_at[at]
            sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
            near = np.zeros(len(sym), bool)
            near[at] = True
            near[at[at > 0] - 1] = True
            touched = np.flatnonzero(near)
            last = len(sym) - 1
            same = touched < last
            inner = touched[same]
            inner_same = word[inner] == word[inner + 1]
            rank[touched] = self.none
            inner = inner[inner_same]
            rank[inner], to[inner] = self._pairs(sym[inner], sym[inner + 1])
        if done_sym:
            sym, word = np.concatenate(done_sym), np.concatenate(done_word)
            by = np.argsort(word, kind="stable")
            sym, word = sym[by], word[by]
        return self._with_bytes(sym, word, len(words))

    def _merge_long(self, sym: np.ndarray) -> np.ndarray:
        """One long word: the same merges one by one, from a heap over linked
        symbols, since rounds over a word that merges once a round would take
        its length squared."""
        if self._pair_of is None:
            self._pair_of = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.to.tolist())))
        base, pair_of = self.size + 0x110000, self._pair_of
        s = sym.tolist()
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            hit = pair_of.get(s[i] * base + s[i + 1])
            if hit:
                heap.append((hit[0], i, s[i], s[i + 1], hit[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, to = heapq.heappop(heap)
            j = after[i]
            if s[i] != left or j >= n or s[j] != right:
                continue                              # one of them has merged since
            s[i], s[j] = to, -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                hit = pair_of.get(to * base + s[j])
                if hit:
                    heapq.heappush(heap, (hit[0], i, to, s[j], hit[1]))
            k = before[i]
            if k >= 0:
                hit = pair_of.get(s[k] * base + to)
                if hit:
                    heapq.heappush(heap, (hit[0], k, s[k], to, hit[1]))
        return np.array([x for x in s if x >= 0], np.int64)

    def _with_bytes(self, sym, word, n_words):
        """Characters without a piece become byte pieces."""
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):
            raw = [chr(int(sym[i]) - self.size).encode() for i in odd]
            reps = np.ones(len(sym), np.int64)
            reps[odd] = [len(r) for r in raw]
            ends = np.cumsum(reps)
            out = np.repeat(sym, reps)
            word = np.repeat(word, reps)
            for i, r in zip(odd, raw):
                out[ends[i] - len(r):ends[i]] = self.byte_id[list(r)]
            sym = out
        return sym.astype(np.int32), np.bincount(word, minlength=n_words)

    def _lookup(self, words: list[str]) -> np.ndarray:
        """Table places of distinct words (without mark); new ones are
        encoded first."""
        fresh = [w for w in words if w not in self._index]
        if fresh:
            # Bounded by words and, for long ones, by characters (pieces are fewer).
            held, more = len(self._index), sum(map(len, fresh))
            if held and (held + len(fresh) > self.table_words or self._start[-1] + more > 8 * self.table_words):
                self._reset()
                fresh = words
            flat, n = self.merge_words([MARK + w for w in fresh])
            used = int(self._start[-1])
            if used + len(flat) > len(self._flat):
                grown = np.zeros(2 * (used + len(flat)), np.int32)
                grown[:used] = self._flat[:used]
                self._flat = grown
            self._flat[used:used + len(flat)] = flat
            base = len(self._index)
            self._index.update(zip(fresh, range(base, base + len(fresh))))
            self._start = np.r_[self._start, used + np.cumsum(n)]
        return np.fromiter(map(self._index.__getitem__, words), np.int64, len(words))

    def _cut_run(self, length: int) -> list[int]:
        """Pieces of a run of ``length`` space marks: leftmost merges first."""
        if length not in self._run_cuts:
            longest = max(self._runs, default=1)
            if length > 4 * longest:                  # cuts repeat after a full-length piece
                head = self._cut_run(longest)
                if len(head) == 1:
                    rest = longest + length % longest
                    self._run_cuts[length] = head * ((length - rest) // longest) + self._cut_run(rest)
                    return self._run_cuts[length]
            parts = [1] * length
            i = 0
            while i + 1 < len(parts):
                if parts[i] + parts[i + 1] in self._runs:
                    parts[i:i + 2] = [parts[i] + parts[i + 1]]
                    i = max(i - 1, 0)
                else:
                    i += 1
            one = int(self.char_id[ord(MARK)])
            self._run_cuts[length] = [one if p == 1 else self._runs[p] for p in parts]
        return self._run_cuts[length]

    # -- texts ---------------------------------------------------------------

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each closed by the end id, and the bounds."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.replace_substring(texts, MARK, " ")
        some = pc.greater(pc.binary_length(texts), 0)
        split = pc.split_pattern(texts.filter(some), " ")
        n_words = np.zeros(len(texts), np.int64)
        n_words[some.to_numpy(zero_copy_only=False)] = pc.list_value_length(split)
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary.to_pylist()
        at = self._lookup(words)[code] if words else np.zeros(0, np.int64)
        blank = code == words.index("") if "" in words else np.zeros(len(code), bool)
        flat, start = self._flat, self._start
        n = start[at + 1] - start[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat(start[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        word_end = np.cumsum(n_words)
        word_start = word_end - n_words
        token = np.r_[0, ends]
        blanks = np.r_[0, np.cumsum(blank)]
        runs = blanks[word_end] > blanks[word_start]
        parts, sizes = [], np.zeros(len(n_words), np.int64)
        end = np.array([self.end_id], np.int32)
        for d in range(len(n_words)):
            lo, hi = int(word_start[d]), int(word_end[d])
            body = ids[token[lo]:token[hi]]
            if runs[d]:
                body = self._with_runs(blank[lo:hi], body, n[lo:hi])
            parts += [body, end]
            sizes[d] = len(body) + 1
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.r_[0, np.cumsum(sizes)]

    def _with_runs(self, blank: np.ndarray, body: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Join the marks of empty words with what follows them."""
        one, out, run, done = int(self.char_id[ord(MARK)]), [], 0, 0
        token = np.r_[0, np.cumsum(n)]
        for i in np.flatnonzero(blank):               # unchanged up to the next empty word
            if run and not blank[i - 1]:
                out, run, done = self._close_run(out, run, body, token, done, i, one)
            if not run and done < i:
                out.append(body[token[done]:token[i]])
            run, done = run + 1, i + 1
        if done < len(n):
            out, run, done = self._close_run(out, run, body, token, done, len(n), one)
        elif run:
            out.append(np.array(self._cut_run(run), np.int32))
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def _close_run(self, out, run, body, token, done, upto, one):
        """The run of marks before word ``done``, then the words up to ``upto``."""
        ids = body[token[done]:token[upto]]
        if ids[0] == one:
            run, ids = run + 1, ids[1:]
        return [*out, np.array(self._cut_run(run), np.int32), ids], 0, upto

    def decode_bytes(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of each id list's text."""
        ids = ids.astype(np.int64)
        lens = np.diff(self._piece_start)[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        flat = self._piece_flat[np.repeat(self._piece_start[ids] - (ends - lens), lens) + np.arange(total)]
        edges = np.r_[0, ends][bounds]
        raw, out = flat.tobytes(), []
        for d in range(len(bounds) - 1):
            text = raw[edges[d]:edges[d + 1]]
            own = ids[bounds[d]:bounds[d + 1]]
            seen = own[lens[bounds[d]:bounds[d + 1]] > 0]
            if text[:1] == b" " and self.marked[seen[0]]:
                text = text[1:]
            if (lens[bounds[d]:bounds[d + 1] - 1] == 0).any():   # bytes do not join across control ids
                text = self._decode_odd(own)
            else:
                try:
                    text.decode()
                except UnicodeDecodeError:
                    text = self._decode_odd(own)
            out.append(text)
        return out

    def _decode_odd(self, ids: np.ndarray) -> bytes:
        """Byte pieces that are not valid UTF-8: each stray byte becomes the
        replacement character."""
        out, run, first = [], b"", True
        for i in [*ids.tolist(), None]:
            if i is not None and self.byte_value[i] >= 0:
                run += self._bytes_of[i]
                first = False
                continue
            while run:
                for k in (1, 2, 3, 4):
                    try:
                        run[:k].decode()
                        out.append(run[:k])
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    k = 1
                    out.append("�".encode())
                run = run[k:]
            if i is None:
                break
            piece = self._bytes_of[i]
            if piece and first:
                piece, first = piece[1:] if self.marked[i] else piece, False
            out.append(piece)
        return b"".join(out)

    def decode(self, id_lists: list) -> list[str]:
        """Text of each list of ids."""
        bounds = np.r_[0, np.cumsum([len(x) for x in id_lists])].astype(np.int64)
        flat = np.concatenate([np.asarray(x, np.int64) for x in id_lists] or [np.zeros(0, np.int64)])
        return [b.decode() for b in self.decode_bytes(flat, bounds)]


_CODECS: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """One codec per Python worker and model file."""
    if model_path not in _CODECS:
        _CODECS[model_path] = PieceCodec(model_path)
    return _CODECS[model_path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id",
                     text_col: str = "text", slice_bytes: int = 3_000_000,
                     outputs: tuple[str, ...] = ("ids", "n_tokens", "decoded")) -> DataFrame:
    """One row per document with ``id_col`` and the asked ``outputs``: ids
    (array of int, end id included), n_tokens, ids_sha256 (decimal ids joined
    by one space), decoded (text), decoded_sha256, round_trip (decoded equals
    the text; U+2581 reads as a space)."""
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("long", pa.int64()),
             "ids_sha256": ("string", pa.string()), "decoded": ("string", pa.string()),
             "decoded_sha256": ("string", pa.string()), "round_trip": ("boolean", pa.bool_())}
    src = docs.select(docs[id_col].alias("k"), docs[text_col].alias("t"))
    key_type = src.schema["k"].dataType.simpleString()
    wanted = tuple(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            keys, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            for lo, hi in in_slices(pc.binary_length(texts).to_pylist(), slice_bytes):
                part = texts.slice(lo, hi - lo)
                ids, bounds = c.encode(part)
                made: dict[str, list] = {}
                if "ids" in wanted:
                    made["ids"] = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                if "n_tokens" in wanted:
                    made["n_tokens"] = np.diff(bounds)
                if "ids_sha256" in wanted:
                    made["ids_sha256"] = [
                        hashlib.sha256(" ".join(map(c.decimal, ids[a:b].tolist())).encode()).hexdigest()
                        for a, b in zip(bounds[:-1], bounds[1:])]
                if {"decoded", "decoded_sha256", "round_trip"} & set(wanted):
                    back = c.decode_bytes(ids, bounds)
                    made["decoded"] = [b.decode() for b in back] if "decoded" in wanted else []
                    made["decoded_sha256"] = [hashlib.sha256(b).hexdigest() for b in back]
                    made["round_trip"] = [
                        b == t.replace(MARK, " ").encode() for b, t in zip(back, part.to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), *[pa.array(made[x], kinds[x][1]) for x in wanted]],
                    names=["k", *wanted])

    schema = ", ".join([f"k {key_type}", *[f"{x} {kinds[x][0]}" for x in wanted]])
    return src.mapInArrow(run, schema).withColumnRenamed("k", id_col)

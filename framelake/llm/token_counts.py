"""Token counts by prefix: how many tokens a text, or any prefix of it, costs, without encoding it again.

The vocabulary is a BPE with word ends.  A *piece* (one match of the pre-tokenizer) is encoded by
itself, and the encoding of a piece has two properties that make a dynamic program over its prefixes
exact: every leading run of tokens is the encoding of the text it covers, and whether token ``t`` may
follow token ``s`` depends on the two alone (encoding their joined text gives back ``s, t``).  So the
last token of every prefix is the one token that ends there and may follow the last token of the
prefix before it, and ``count[i] = count[i - len(t)] + 1``.  The tables over the pieces of a text are
chained by a running sum.

Texts are cut at white space first; white space never joins, composes or survives in this
vocabulary, so each chunk has its own counts, kept in a bounded table per task.

The stored table has an entry for every code point that is not white space, inside chunks too, so a text
without spaces can be cut anywhere.  What a cut changes besides the last piece is counted for that prefix
alone: a contraction cut short, a combining mark that joins what stands before it, a special string.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import ahocorasick
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import arrow_rows

VOCABULARY = "word_bpe_49k.json"
CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")
# Printable ASCII and Latin letters that stay single, composed letters in lower case; the pre-tokenizer's cut of them.
PLAIN = re.compile("[!-~À-ÖØ-öø-įĲ-ž]+")
PLAIN_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-zß-öø-ž0-9]+")
LETTERS = "".join(map(chr, range(0xDF, 0x17F)))
# Longest chunk whose counts are remembered, and how many chunks a task remembers before it starts anew.
REMEMBERED_CHARS, REMEMBERED = 48, 1_000_000


class PrefixCounter:
    """Token counts of every prefix, for one vocabulary file of BPE with word ends."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model = described["model"]
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        self.parts: dict[str, tuple[str, str]] = {}
        self.made: dict[str, int] = {}
        for k, (left, right) in enumerate(merges):
            if left + right not in self.made:
                self.made[left + right], self.parts[left + right] = k, (left, right)
        tokens = [t for t in model["vocab"] if self._is_stable(t)]
        self.find = ahocorasick.Automaton()  # tokens that do not end a piece
        for token in tokens:
            if not token.endswith(self.end):
                self.find.add_word(token, token)
        self.find.make_automaton()
        self.closed = {t.removesuffix(self.end) for t in tokens if t.endswith(self.end)}
        self.longest = max(map(len, self.closed))
        self.symbols = {c: v for c, v in zip(map(ord, LETTERS), self._byte_symbols(), strict=True) if len(v) > 1}
        self.special = [t["content"] for t in described["added_tokens"]]
        self._follows: dict[tuple[str, str], bool] = {}
        self._pieces: dict[str, int] = {}
        self._chunks: dict[str, int] = {}

    def _byte_symbols(self) -> list[str]:
        """What byte-level pre-tokenization writes for each of ``LETTERS``."""
        return [self.library.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in LETTERS]

    def _is_stable(self, token: str) -> bool:
        """Whether the token's own text is encoded as this one token."""
        if token not in self.parts:
            return len(token.removesuffix(self.end)) == 1
        return self._crossing_free(*self.parts[token], final=False)

    def _crossing_free(self, left: str, right: str, final: bool = True) -> bool:
        """Whether no merge crosses the border of two neighbours before both are complete.

        Undo the merges of the two tokens from the last one backwards; a merge of the two parts that
        meet at the border and that ranks before the merge undone last would have come first.  Of
        equal ranks the left one comes first.  ``final``: a merge of the complete tokens counts too.
        """
        limit = len(self.rank) if final else -1
        while True:
            crossing = self.rank.get((left, right))
            if crossing is not None and crossing < limit:
                return False
            of_left, of_right = self.made.get(left, -1), self.made.get(right, -1)
            if of_left > of_right:
                limit, left = of_left, self.parts[left][1]
            elif of_right >= 0:
                limit, right = of_right + 1, self.parts[right][0]
            else:
                return True

    def _may_follow(self, before: str, token: str) -> bool:
        known = self._follows.get((before, token))
        if known is None:
            if len(self._follows) >= REMEMBERED:
                self._follows.clear()
            known = self._follows[(before, token)] = self._crossing_free(before, token)
        return known

    def _opened_prefixes(self, piece: str) -> tuple[list[str], list[int]]:
        """Last token and token count of every prefix that is not the end of its piece."""
        n, follows = len(piece), self._follows
        last, counts, done = [""] * n, [0] * n, n
        for end, token in self.find.iter(piece, 0, n - 1) if n > 1 else ():
            if end + 1 != done:
                i = end + 1 - len(token)
                if i:
                    known = follows.get((last[i], token))
                    if not known and (known is False or not self._may_follow(last[i], token)):
                        continue
                done = end + 1
                last[done], counts[done] = token, counts[i] + 1
        return last, counts

    def _closed(self, piece: str, j: int, last: list[str], counts: list[int]) -> int:
        """Tokens of ``piece[:j]`` as a piece of its own."""
        for i in range(max(0, j - self.longest), j):
            body = piece[i:j]
            if body in self.closed and (not i or self._may_follow(last[i], body + self.end)):
                break
        return counts[i] + 1

    def piece_prefixes(self, piece: str) -> list[int]:
        """``counts[j]``: tokens of the first ``j`` byte symbols of a piece, encoded as a piece of their own."""
        last, counts = self._opened_prefixes(piece)
        return [0, *(self._closed(piece, j, last, counts) for j in range(1, len(piece) + 1))]

    def pieces(self, chunk: str) -> list[str]:
        """Byte-symbol pieces that the library's normaliser and pre-tokenizer make of a chunk."""
        if PLAIN.fullmatch(chunk):  # the same, for letters, digits and signs that the two leave as they are
            found = PLAIN_PIECE.findall(chunk.lower())
            return found if chunk.isascii() else [p.translate(self.symbols) for p in found]
        normal = self.library.normalizer.normalize_str(chunk)
        return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def count_chunk(self, chunk: str) -> int:
        """Tokens of a text without white space."""
        if "<|" in chunk and any(s in chunk for s in self.special):
            return len(self.library.encode(chunk, add_special_tokens=False).ids)
        return sum(map(self._count_piece, self.pieces(chunk)))

    def _count_piece(self, piece: str) -> int:
        if piece in self.closed:
            return 1
        known = self._pieces.get(piece)
        if known is None:
            known = self._closed(piece, len(piece), *self._opened_prefixes(piece))
            if len(piece) <= REMEMBERED_CHARS:
                if len(self._pieces) >= REMEMBERED:
                    self._pieces.clear()
                self._pieces[piece] = known
        return known

    def chunk_counts(self, text: str) -> list[int]:
        """Tokens of every white-space chunk of the text, in order."""
        chunks = CHUNK.findall(text)
        known = self._chunks
        if len(known) > REMEMBERED:
            known.clear()
        counts = list(map(known.get, chunks))
        if None in counts:
            for k, (chunk, n) in enumerate(zip(chunks, counts, strict=True)):
                if n is None:
                    n = known.get(chunk)
                    if n is None:
                        n = self.count_chunk(chunk)
                        if len(chunk) <= REMEMBERED_CHARS:
                            known[chunk] = n
                    counts[k] = n
        return counts

    def count(self, text: str) -> int:
        return sum(self.chunk_counts(text))

    def _spans(self, normal: str) -> list[tuple[int, int, str]]:
        """Begin, end and byte symbols of the pieces of a normalised chunk."""
        return [(a, b, piece) for piece, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _clusters(self, chunk: str) -> list[tuple[str, str]]:
        """The chunk in parts that normalise each for itself, with their normal forms."""
        normalize = self.library.normalizer.normalize_str
        if chunk.isascii():
            return [(c, n) for c, n in zip(chunk, normalize(chunk), strict=True)]
        known: dict[str, str] = {}
        out: list[tuple[str, str]] = []
        for c in chunk:
            n = known.get(c)
            if n is None:
                n = known[c] = normalize(c)
            if out:
                before, made = out[-1]
                if unicodedata.combining(c) or not c.isascii() and normalize(before + c) != made + n:
                    out[-1] = (before + c, normalize(before + c))
                    continue
            out.append((c, n))
        return out

    def _plain_prefixes(self, chunk: str) -> list[int]:
        """``counts[j]``: tokens of the first ``j`` code points of a chunk in which no special string is seen."""
        clusters = self._clusters(chunk)
        normal = "".join(n for _, n in clusters)
        if normal != self.library.normalizer.normalize_str(chunk):
            return [self._count_plain(chunk[:j]) for j in range(len(chunk) + 1)]
        at = [0] * (len(normal) + 1)  # tokens of every prefix of the normal form
        starts: list[int] = []  # of the pieces
        total = done = 0
        for a, b, piece in self._spans(normal):
            at[done:a + 1] = [total] * (a + 1 - done)
            starts.append(a)
            inner = self.piece_prefixes(piece)
            symbols = 0
            for x in range(a + 1, b + 1):
                symbols += len(normal[x - 1].encode())
                at[x] = total + inner[symbols]
            if piece[0] == "'" and b - a > 1 and normal[a + 1].isalpha():  # a contraction, which its own prefixes are not
                for x in range(a + 1, b):
                    at[x] = total + self._count_plain(normal[a:x])
            total, done = at[b], b
        at[done:] = [total] * (len(normal) + 1 - done)
        counts, x = [0], 0
        for raw, made in clusters:
            for j in range(1, len(raw)):  # a prefix that ends inside a cluster: its last two pieces may be others
                k = bisect_right(starts, x) - 2
                begin = starts[k] if k > 0 else 0
                counts.append(at[begin] + self._count_plain(normal[begin:x] + raw[:j]))
            x += len(made)
            counts.append(at[x])
        return counts

    def _count_plain(self, chunk: str) -> int:
        return sum(map(self._count_piece, self.pieces(chunk)))

    def chunk_prefixes(self, chunk: str) -> list[int]:
        """``counts[j]``: tokens of the first ``j`` code points of a text without white space."""
        counts, begin = [0], 0
        if "<|" in chunk:
            for found in re.finditer("|".join(map(re.escape, self.special)), chunk):
                base = counts[-1]  # a special string is one token, its own prefixes are plain text
                counts += [base + n for n in self._plain_prefixes(chunk[begin:found.end() - 1])[1:]]
                before = self._count_plain(chunk[begin:found.start()])
                counts.append(base + before + 1)
                begin = found.end()
        base = counts[-1]
        return counts + [base + n for n in self._plain_prefixes(chunk[begin:])[1:]]

    def prefix_table(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of all prefixes of ``text`` that end in a code point other than white space, and the tokens of each."""
        ends: list[int] = []
        sums: list[int] = []
        total, known = 0, {}
        for m in CHUNK.finditer(text):
            chunk = m[0]
            counts = known.get(chunk)
            if counts is None:
                counts = self.chunk_prefixes(chunk)
                if len(chunk) <= REMEMBERED_CHARS:
                    known[chunk] = counts
            ends.extend(range(m.start() + 1, m.end() + 1))
            sums.extend(total + n for n in counts[1:])
            total += counts[-1]
        return ends, sums

    def count_prefix(self, text: str, chars: int, made: tuple[list[int], list[int]] | None = None) -> int:
        """Tokens of ``text[:chars]``, from the table alone."""
        ends, sums = made or self.prefix_table(text)
        k = bisect_right(ends, chars)
        return sums[k - 1] if k else 0

    def longest_within(self, text: str, budget: int, made: tuple[list[int], list[int]] | None = None) -> int:
        """Length of the longest prefix, without white space at its end, that costs at most ``budget`` tokens.

        A longer prefix may cost less than a shorter one, so the last that fits counts.
        """
        ends, sums = made or self.prefix_table(text)
        return next((end for end, n in zip(reversed(ends), reversed(sums), strict=True) if n <= budget), 0)


def _path(vocabulary: str) -> str:
    return vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)


def token_counts(docs: DataFrame, limit: int = 2048, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Bytes and tokens of every whole text.

    Reads ``doc_id`` and ``text`` and passes the columns ``keep`` on; one row per row, repeated rows
    included.  A null or empty text has 0 bytes and 0 tokens, whatever its other columns hold.
    Special strings inside a text count as the library counts them by default.
    """
    counted = T.StructType([
        T.StructField("doc_id", T.LongType()), *[docs.schema[c] for c in keep],
        T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
    ])

    def row():
        counter = PrefixCounter(_path(vocabulary))

        def one(doc_id, text, *kept):
            text = text or ""
            return (doc_id, *kept, len(text.encode()), counter.count(text))

        return one

    made = arrow_rows(docs, row, ["doc_id", "text", *keep], counted)
    return made.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_table(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``ends`` and ``sums``: the stored counts, one entry per code point but white space (null text: empty arrays)."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("sums", T.ArrayType(T.LongType())),
    ])

    def row():
        counter = PrefixCounter(_path(vocabulary))
        return lambda doc_id, text: (doc_id, *counter.prefix_table(text or ""))

    return arrow_rows(docs, row, ["doc_id", "text"], schema)


def truncate_to_budget(docs: DataFrame, tables: DataFrame, budget: int) -> DataFrame:
    """Cut each text to its longest prefix within ``budget`` tokens, from the stored table alone.

    ``tables`` must have one row per ``doc_id``; texts without a table row, and null texts, become empty.
    """
    fitting = F.filter(F.arrays_zip("ends", "sums"), lambda x: x["sums"] <= budget)  # sums may fall inside a chunk
    cut = tables.select("doc_id", F.coalesce(F.try_element_at(fitting, F.lit(-1))["ends"], F.lit(0)).alias("_cut"))
    return docs.join(cut, "doc_id", "left").withColumn(
        "text", F.coalesce(F.substring(F.col("text"), F.lit(1), F.coalesce(F.col("_cut"), F.lit(0)).cast("int")), F.lit(""))
    ).drop("_cut")

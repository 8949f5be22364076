"""Token counts of byte-level BPE at every prefix of a text, by dynamic programming.

BPE has one last token for each prefix of a piece of text: the token t whose
start leaves a shorter prefix with a last token that may stand before t. Two
tokens may stand side by side if encoding their joined bytes gives back just
these two. So the count of a prefix is the count of the shorter one plus one, and
one pass over a piece gives the count of each of its prefixes. Truncation and
budget questions are then look-ups.

Pieces are what the vocabulary's own splitting rule cuts a text into. The count
of a piece does not depend on its neighbours, so each worker keeps what it has
already counted, up to a bound.
"""

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockside.llm.common import record_batch, worker_memo

# White space and the splitting rule of the vocabulary.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+"
    r"|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
CONTRACTIONS = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])

# Words that a worker remembers at most.
REMEMBERED = 300_000

# Count of a word that cannot be counted by itself.
UNEVEN = -(1 << 40)


def byte_alphabet() -> dict[str, int]:
    """Byte of each character in which byte-level vocabularies are written.

    Printable bytes stand for themselves; the others follow from code point 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_rules(held: dict) -> None:
    """Stop where a vocabulary file splits or merges by other rules than the ones written here."""
    model, split = held["model"], held.get("pre_tokenizer") or {}
    wrong = [
        name
        for name, right in (
            ("normalizer", held.get("normalizer") is None),
            ("pre_tokenizer", split.get("type") == "ByteLevel"),
            ("add_prefix_space", split.get("add_prefix_space") is False),
            ("use_regex", split.get("use_regex", True) is True),
            ("model", model.get("type", "BPE") == "BPE"),
            ("dropout", not model.get("dropout")),
            ("ignore_merges", not model.get("ignore_merges")),
            ("continuing_subword_prefix", not model.get("continuing_subword_prefix")),
            ("end_of_word_suffix", not model.get("end_of_word_suffix")),
        )
        if not right
    ]
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    wrong += [f"{flag} of {t['content']}" for t in held["added_tokens"] for flag in flags if t.get(flag)]
    if wrong:
        raise ValueError(f"this vocabulary has other rules: {', '.join(wrong)}")


class Counter:
    """Counts of one vocabulary file of the library ``tokenizers``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        check_rules(held)
        alphabet = byte_alphabet()

        def raw(token):
            return bytes(alphabet[c] for c in token)

        specials = {t["content"] for t in held["added_tokens"]}
        self.specials = sorted(specials, key=len, reverse=True)
        self.token = {raw(t): i for t, i in held["model"]["vocab"].items() if t not in specials}
        self.bytes_of = {i: t for t, i in self.token.items()}
        self.rank = {}
        for place, merge in enumerate(held["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[self.token[raw(left)], self.token[raw(right)]] = (
                place,
                self.token[raw(left) + raw(right)],
            )
        # A token may only end where all its own endings are endings of some token.
        self.endings = {t[i:] for t in self.token for i in range(len(t))}
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if specials else None
        self.edge = regex.compile(f"[{SPACE}]|.*[{SPACE}]", regex.DOTALL)
        self.blank = regex.compile(f"[{SPACE}]+")
        self.fits: dict[tuple, bool] = {}
        self.words: dict[str, int] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Tokens of a short piece by merging; used only to see which tokens fit together."""
        parts = [self.token[piece[i : i + 1]] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(
                ((self.rank.get(pair, (1 << 60, 0)), i) for i, pair in enumerate(zip(parts, parts[1:]))),
                key=lambda x: (x[0][0], x[1]),
            )
            if best[0][0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [best[0][1]]
        return parts

    def may_follow(self, left, right) -> bool:
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            start = self.bytes_of[left] if left is not None else b""
            wanted = [left, right] if left is not None else [right]
            known = self.fits[key] = self.merged(start + self.bytes_of[right]) == wanted
            if len(self.fits) > 2 * REMEMBERED:
                self.fits.clear()
        return known

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of every prefix of a piece: entry i is for its first i bytes."""
        return self._extend(piece, [0], [None])[0]

    def _extend(self, piece: bytes, counts: list, last: list) -> tuple[list, list]:
        """Carry on counts and last tokens that are known for a start of the piece."""
        token, endings, fits = self.token, self.endings, self.fits
        for end in range(len(counts), len(piece) + 1):
            found = []
            start = end - 1
            while start >= 0:
                ending = piece[start:end]
                if ending not in endings:
                    break
                t = token.get(ending)
                if t is not None:
                    found.append((start, t))
                start -= 1
            for start, t in reversed(found):
                known = fits.get((last[start], t))
                if known or known is None and self.may_follow(last[start], t):
                    counts.append(counts[start] + 1)
                    last.append(t)
                    break
        return counts, last

    def _count_pieces(self, pieces: set[str]) -> dict[str, int]:
        """Counts of many pieces; what begins alike is worked out once."""
        out = {}
        before, counts, last = b"", [0], [None]
        for piece in sorted(x.encode() for x in pieces):
            same = 0
            for same, (a, b) in enumerate(zip(before, piece)):
                if a != b:
                    break
            else:
                same = min(len(before), len(piece))
            del counts[same + 1 :], last[same + 1 :]
            self._extend(piece, counts, last)
            out[piece.decode()] = counts[-1]
            before = piece
        return out

    def _count_words(self, words: list[str], lead: str) -> list[int]:
        """Tokens of each word after ``lead``; UNEVEN for words that have a blank at an end."""
        counts = list(map(self.words.get, [lead + w for w in words] if lead else words))
        missing = [w for w, n in zip(words, counts) if n is None]
        if not missing:
            return counts
        even = {w: self.split.findall(lead + w) for w in missing if w and not self.edge.fullmatch(w)}
        known = self._count_pieces({p for pieces in even.values() for p in pieces})
        fresh = {w: sum(map(known.__getitem__, even[w])) if w in even else UNEVEN for w in missing}
        for word in missing[: max(0, REMEMBERED - len(self.words))]:
            self.words[lead + word] = fresh[word]
        return [fresh[w] if n is None else n for w, n in zip(words, counts)]

    def count_all(self, texts: pa.Array) -> list[int]:
        """Tokens of whole texts.

        Where single blanks stand between words, each word is split by itself
        together with its blank; all other texts go the plain way.
        """
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        numbered = lists.flatten().dictionary_encode()
        words = numbered.dictionary.to_pylist()
        place = numbered.indices.to_numpy()
        counts = np.array(self._count_words(words, " "), dtype=np.int64)[place]
        # The first word of a text has no blank before it.
        heads = offsets[:-1]
        counts[heads] = 0
        total = np.diff(np.concatenate([[0], np.cumsum(counts)])[offsets])
        firsts = [words[i] for i in place[heads]]
        texts = texts.to_pylist()
        out = []
        for text, first, n in zip(texts, firsts, total.tolist()):
            special = self.special is not None and any(s in text for s in self.specials)
            if special or n < 0 or self.edge.fullmatch(first):
                out.append(self.count(text))
            else:
                out.append(n + self._segment(first))
        return out

    def _segment(self, text: str) -> int:
        """Tokens of a text without special strings."""
        return sum(self.prefix_counts(p.encode())[-1] for p in self.split.findall(text))

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string in it is one token."""
        if self.special is None or not self.special.search(text):
            return self._segment(text)
        parts = self.special.split(text)
        return sum(map(self._segment, parts)) + len(parts) - 1

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of every prefix: entry i is for the first i characters."""
        found = [0]
        start = 0
        for match in [*(self.special.finditer(text) if self.special else ()), None]:
            end = match.start() if match else len(text)
            stop = match.end() - 1 if match else end
            before = found[start]
            found += [before + n for n in self._plain_prefixes(text[start:stop])]
            if match:
                found.append(found[end] + 1)
                start = match.end()
        return np.asarray(found, dtype="int64")

    def _plain_prefixes(self, text: str) -> list[int]:
        """As :meth:`prefixes`, without the empty prefix, where no string is special."""
        out: list[int] = []
        whole = 0  # tokens of the pieces that are complete
        blank_from, blank_base = None, 0
        for piece in self.split.findall(text):
            counts = self.prefix_counts(piece.encode())
            for i in range(1, len(piece) + 1):
                part = piece[:i]
                if self.blank.fullmatch(part):
                    # White space up to the end of a prefix is one piece.
                    at = len(out)
                    if blank_from is None:
                        blank_from, blank_base = at, whole
                    run = text[blank_from : at + 1].encode()
                    out.append(blank_base + self.prefix_counts(run)[-1])
                    continue
                blank_from = None
                if piece in CONTRACTIONS and i < len(piece):
                    parts = self.split.findall(part)
                    out.append(whole + sum(self.prefix_counts(p.encode())[-1] for p in parts))
                else:
                    out.append(whole + counts[len(part.encode())])
            whole += counts[-1]
        return out


def counter_for(path: str) -> Counter:
    """The worker's counter of a vocabulary file."""
    memo = worker_memo("token_counters")
    if path not in memo:
        memo[path] = Counter(path)
    return memo[path]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``path`` is a byte-level vocabulary file that every node has. A NULL text is
    empty and has no tokens; a NULL ``doc_id`` is passed on; repeated rows give
    repeated results; other columns are ignored. No shuffle.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
    )

    def count(batches):
        counter = counter_for(path)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
            tokens = []
            for start in range(0, batch.num_rows, 4096):
                tokens += counter.count_all(batch.column(1).slice(start, 4096))
            yield record_batch(schema, batch.column(0), sizes, tokens, [n > limit for n in tokens])

    return _texts(docs).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """The count at every prefix: ``doc_id, prefix_tokens`` (element i: first i characters).

    ``prefix_tokens[n]`` answers how many tokens a text cut to n characters has,
    and :func:`longest_within` how much of it fits a budget, without encoding.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("prefix_tokens", pa.list_(pa.int64()))])

    def table(batches):
        counter = counter_for(path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, batch.column(1).to_pylist()):
                # A row each: the table of a text is eight times as long as the text.
                yield record_batch(schema, [doc_id], [counter.prefixes(text)])

    return _texts(docs).mapInArrow(table, "doc_id long, prefix_tokens array<bigint>")


def longest_within(prefix_tokens: str, budget: int):
    """Column: the most characters from the start that take at most ``budget`` tokens."""
    fitting = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fitting)

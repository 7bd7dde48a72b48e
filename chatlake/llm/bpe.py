"""Byte-pair encoding and decoding by per-prefix dynamic programming.

For every prefix of a word there is one token that ends its encoding.  A token
is that last token if it ends there, if it encodes to itself, and if the last
token of what stands before it and it are compatible: merging their bytes
would never join something across their border.  So one pass over a word
stores the last token of each prefix, and the ids are read off backwards.

* Which tokens end at a position comes from a suffix automaton of all tokens:
  its state after a symbol is the longest stretch that ends there and occurs in
  some token; the suffix links from there on pass every token that ends there.
* Compatibility walks two spines from the border outwards: the right spine of
  the left token (its pieces that touch the border, smallest first) and the
  left spine of the right one.  A pair of pieces stands side by side until
  either is merged into its parent; if it has a merge of its own that comes
  first, the border would not hold.  Of equal merges the leftmost comes first.

A symbol is a byte, or a byte that ends its word.  Texts are cut into words as
the tokenizer file says: stretches of Latin letters, digits and ASCII signs by
the same pattern here, all others by the tokenizer's own normalizer and
pre-tokenizer.  Words are looked up among those that the worker has met.
Special tokens are found in the raw text, as the tokenizer does.

Scale: texts are encoded where they are read; nothing is shuffled, and a task
holds one batch, the automaton (about 100 MB) and at most ``WORDS`` words.

Defined results: null text is the empty text, which has no ids and decodes to
the empty text; whole texts are encoded, however long; repeated rows are
encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words that a worker remembers with their ids.
WORDS = 600_000
_NEVER = 1 << 40

#: Fixed values of the public tokenizer file: the mark of a word's last symbol and the pattern of words.
END = "</w>"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Texts that need no normalizer but lower case: printable ASCII, composed Latin letters with one lower form, and
#: the white space that Python and the tokenizer agree on.
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_BLANK = " \t\n\x0b\x0c\r"
_SIMPLE = re.compile(f"[!-~{_LATIN}{_BLANK}]*")
_BLANKS = re.compile(f"[{_BLANK}]+")
_CUT = re.compile(PATTERN.replace(r"\p{L}", "a-zà-öø-ſß").replace(r"\p{N}", "0-9").replace(r"\s", _BLANK))


class SuffixAutomaton:
    """Suffix automaton of several words over symbols below ``1 << bits``."""

    def __init__(self, bits: int = 10):
        self.bits, self.next, self.link, self.length = bits, {}, array("i", [-1]), array("i", [0])
        self.symbols: list[list[int]] = [[]]

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.symbols.append([])
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the shorter members of ``q``, reached from ``p`` by ``c``."""
        bits, nxt = self.bits, self.next
        clone = self._state(self.length[p] + 1, self.link[q])
        for s in self.symbols[q]:
            nxt[clone << bits | s] = nxt[q << bits | s]
        self.symbols[clone] = list(self.symbols[q])
        self.link[q] = clone
        while p >= 0 and nxt.get(p << bits | c) == q:
            nxt[p << bits | c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        bits, nxt, link, length = self.bits, self.next, self.link, self.length
        q = nxt.get(last << bits | c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur, p = self._state(length[last] + 1, 0), last
        while p >= 0 and (p << bits | c) not in nxt:
            nxt[p << bits | c] = cur
            self.symbols[p].append(c)
            p = link[p]
        if p >= 0:
            q = nxt[p << bits | c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def add(self, word: list[int]) -> None:
        last = 0
        for c in word:
            last = self._extend(last, c)

    def state_of(self, word: list[int]) -> int:
        s = 0
        for c in word:
            s = self.next[s << self.bits | c]
        return s


class PrefixBpe:
    """Encoder and decoder of one tokenizer file whose words end in a marked symbol."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if model["end_of_word_suffix"] != END or split != PATTERN or spec["decoder"] or model["unk_token"]:
            raise ValueError(f"{path} is not a tokenizer with words that end in {END}")
        whole = Tokenizer.from_file(path)
        self.normalize, self.cut = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        vocab = model["vocab"]
        # A symbol per byte character, and one per byte character that ends its word.
        plain = sorted((c for c in vocab if len(c) == 1), key=vocab.get)
        self.symbol = {c: i for i, c in enumerate(plain)}
        self.ends = len(plain)
        base = [vocab[c] for c in plain] + [vocab[c + END] for c in plain]
        self._byte_symbols()
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        # Merges: rank of a pair of ids, and the two pieces of a token with the rank that makes it.
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (x, y) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            pair = vocab[x], vocab[y]
            self.rank.setdefault(pair, rank)
            made.setdefault(vocab[x + y], (rank, *pair))
        self._spines(base, made)
        self._automaton(base, made)
        self.known: dict[str, bytes] = {}

    def _byte_symbols(self) -> None:
        """Symbol of every byte: printable bytes stand for themselves, the others for characters from 256 on."""
        itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in itself}
        for k, b in enumerate(b for b in range(256) if b not in char):
            char[b] = chr(256 + k)
        self.of_byte = [self.symbol[char[b]] for b in range(256)]

    def _spines(self, base: list[int], made: dict) -> None:
        """Border pieces of every token, smallest first, each with the rank that merges it into the next."""
        self.right: dict[int, list[tuple[int, int]]] = {i: [(i, _NEVER)] for i in base}
        self.left: dict[int, list[tuple[int, int]]] = {i: [(i, _NEVER)] for i in base}
        for t in sorted(made, key=lambda i: made[i][0]):
            rank, x, y = made[t]
            if x in self.left and y in self.right:
                self.left[t] = [*self.left[x][:-1], (x, rank), (t, _NEVER)]
                self.right[t] = [*self.right[y][:-1], (y, rank), (t, _NEVER)]
        # A token encodes to itself if its pieces do and nothing crosses their border before they merge.
        self.own = set(base)
        for t in sorted(self.left, key=lambda i: made[i][0] if i in made else -1):
            if t in made:
                rank, x, y = made[t]
                if x in self.own and y in self.own and self._holds(x, y, rank):
                    self.own.add(t)
        self.pairs: dict[tuple[int, int], bool] = {}

    def _holds(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Nothing is merged across the border of ``a`` and ``b`` (by merges other than that of a and b at ``before``)."""
        right, left, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, up_x), (y, up_y) = right[i], left[j]
            rank = self.rank.get((x, y), _NEVER)
            top = up_x == _NEVER and up_y == _NEVER
            if top:
                return rank == _NEVER or rank == before
            if rank < up_x and rank <= up_y:
                return False
            if up_x <= up_y:
                i += 1
            else:
                j += 1

    def _automaton(self, base: list[int], made: dict) -> None:
        """Suffix automaton of all tokens; for every state the tokens that end there, longest first, and where more are."""
        ends, auto = self.ends, SuffixAutomaton()
        words: dict[int, list[int]] = {}
        for t in sorted(self.own):
            text = self.token[t]
            last = text.endswith(END) and len(text) > len(END)
            word = [self.symbol[c] for c in (text[:-len(END)] if last else text)]
            if last:
                word[-1] += ends
            words[t] = word
            auto.add(word)
        tokens: dict[int, list[tuple[int, int]]] = {}
        for t, word in words.items():
            tokens.setdefault(auto.state_of(word), []).append((len(word), t))
        for v in tokens.values():
            v.sort(reverse=True)
        # Nearest state up the suffix links that has tokens (itself included).
        by_length = sorted(range(1, len(auto.link)), key=auto.length.__getitem__)
        near = array("i", [0]) * len(auto.link)
        for s in by_length:
            near[s] = s if s in tokens else near[auto.link[s]]
        self.next, self.bits, self.link, self.length = auto.next, auto.bits, auto.link, auto.length
        self.near, self.tokens = near, tokens

    def word(self, symbols: list[int]) -> list[int]:
        """Ids of one word, the last of its symbols marked."""
        nxt, bits, link, length, near, tokens = self.next, self.bits, self.link, self.length, self.near, self.tokens
        pairs, last, size = self.pairs, [-1], [0]
        state = match = 0
        for p, c in enumerate(symbols, 1):
            go = nxt.get(state << bits | c)
            while go is None:  # every symbol is a token, so the empty match goes on
                state = link[state]
                match = length[state]
                go = nxt.get(state << bits | c)
            state, match = go, match + 1
            s, found = near[state], False
            while not found:
                for n, t in tokens[s]:
                    if n > match:
                        continue
                    before = last[p - n]
                    if before >= 0:
                        fits = pairs.get((before, t))
                        if fits is None:
                            fits = self._holds(before, t)
                            if len(pairs) < 2_000_000:
                                pairs[before, t] = fits
                        if not fits:
                            continue
                    last.append(t)
                    size.append(n)
                    found = True
                    break
                else:
                    s = near[link[s]]
        out, p = [], len(symbols)
        while p:
            out.append(last[p])
            p -= size[p]
        return out[::-1]

    def _new(self, word: str, symbols: list[int]) -> bytes:
        symbols[-1] += self.ends
        ids = array("I", self.word(symbols)).tobytes()
        if 0 < len(word) < 40 and len(self.known) < WORDS:
            self.known[word] = ids
        return ids

    def _simple(self, text: str, out: list[bytes]) -> None:
        """Words of a text that needs lower case only."""
        known, of = self.known.get, self.of_byte
        for w in _CUT.findall(text.lower()):
            ids = known(w)
            out.append(self._new(w, [of[b] for b in w.encode()]) if ids is None else ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for k, part in enumerate(self.special_cut.split(text)):
            if k % 2:
                out.append(array("I", [self.special[part]]).tobytes())
            elif _SIMPLE.fullmatch(part):
                self._simple(part, out)
            else:
                # Nothing is joined or changed across white space, so odd chunks go their own way.
                for chunk in _BLANKS.split(part):
                    if _SIMPLE.fullmatch(chunk):
                        self._simple(chunk, out)
                    else:
                        for w, _ in self.cut(self.normalize(chunk)):
                            out.append(self._new("", [self.symbol[c] for c in w]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens' texts, a blank between them (the file names no decoder)."""
        token = self.token
        return " ".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


_MADE: dict[str, PrefixBpe] = {}


def default_file() -> str:
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


def encoder(path: str) -> PrefixBpe:
    """The worker's encoder of a file, made once."""
    if path not in _MADE:
        _MADE[path] = PrefixBpe(path)
    return _MADE[path]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded text of every row."""
    path = path or default_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                ids = [bpe.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array([bpe.decode(i) for i in ids], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")

"""BPE encoding and decoding with a tokenization automaton.

Compilation starts from the automaton with one state and an arc per base symbol, and applies
one gadget per merge, in rank order. The gadget of ``u v -> w`` splits off, from the state q that
arcs labelled u lead to, a copy without an arc v; arcs u lead to the copy from now on,
and every state with an arc u gets an arc w to where v led from q. The result is deterministic, and
the label sequences it accepts are exactly the token sequences that the merges produce.

All arcs with one label lead to one state, so a state is known by its last label. A gadget takes its arc from the
states that descend from q by their last parts, and with it all labels that would have been handed on through it; numbered
by their parts, the latest first, both are ranges. So each gadget clears one rectangle of the state x label table. The
table is written out by the driver, its equal pages stored once (20 MB with the trie for 49,000 merges), and broadcast.

A word is scanned once, left to right, without going back: at every position the state is known, as each prefix has exactly one
accepted path, and the labels that begin there (a trie) and have an arc set the states where they end. The path is then read off
from the word's end. Work and memory are linear in the word's length.

Words repeat; each Python worker keeps a bounded table of words already encoded. Decoding emits
the labels of the arcs, as this tokenizer file (it names no decoder) joins them: by single spaces.

Defined results: a null text is empty and has no tokens; special tokens in a text are themselves
(the library's default); characters outside Unicode scalar values don't occur in Spark strings;
extra columns are ignored; a file that normalises or splits otherwise is refused. Unicode classes and small letters are the library's, on every code point.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import unicodedata
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyspark.llm import common as C

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: What the tokenizer file must say of normalisation and splitting, as that is written out here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Ranges of characters that the installed ``regex`` knows as letters or numbers and the tokenizers library, whose tables are older, does not.
UNKNOWN = """0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB
11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168
1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
#: Ranges of capitals that the library lower-cases and Python does not, with their first small letter.
CAPITALS = "1C89:1C8A A7CB:0264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:019B 10D50-10D65:10D70 16EA0-16EB8:16EBB"


def _ranges(text: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (r.partition("-") for r in text.split())]


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges)


_CAPITALS = [(*_ranges(a)[0], int(b, 16)) for a, _, b in (r.partition(":") for r in CAPITALS.split())]
SMALL = {a + k: chr(b + k) for a, end, b in _CAPITALS for k in range(end - a + 1)}
_UNKNOWN = _class(_ranges(UNKNOWN))
RARE = regex.compile(f"[{_UNKNOWN}{_class([(a, b) for a, b, _ in _CAPITALS])}]")
#: SPLIT for texts that hold such characters.
RARE_SPLIT = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_UNKNOWN}]]+|[\p{{N}}--[{_UNKNOWN}]]|(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|[{_UNKNOWN}])+")
#: Words that a Python worker remembers at most.
WORDS = 200_000
#: Labels of a page of the table.
PAGE = 256
#: Rows of the table that the driver writes out at a time.
ROWS = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Gadgets:
    """The merges applied one by one. ``split``: the rank at which state u lost arc v; ``left``, ``right``, ``born``: parts and rank of a label."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [(vocab[u], vocab[v], vocab[u + v]) for u, v in (m if not isinstance(m, str) else m.split(" ") for m in merges)]
        made = {w for _, _, w in pairs}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born = {t: -1 for t in vocab.values() if t not in made}
        self.split: dict[tuple[int, int], int] = {}
        for rank, (u, v, w) in enumerate(pairs):
            if u in self.born and v in self.born and self.arc(u, v, rank):
                self.split[u, v] = rank
                self.left[w], self.right[w], self.born[w] = u, v, rank

    def arc(self, a: int, b: int, now: int) -> bool:
        """Whether, after the gadgets before ``now``, the state behind a has an arc b.

        The state's missing arcs are its own splits and those it inherited from its right part by its birth; b was handed
        on by its left part at its birth, which must still have been there."""
        split, left, right, born = self.split, self.left, self.right, self.born
        state, until = a, now
        while True:
            label, deadline = b, now
            while True:
                rank = split.get((state, label))
                if rank is not None and rank < until and rank <= deadline:
                    return False
                if label not in left:
                    break
                label, deadline = left[label], min(deadline, born[label])
            if state not in right:
                return True
            state, until = right[state], min(until, born[state])


class Numbering:
    """Labels in the order of a walk from each part to the labels made of it, the latest first: those made of a label after a given rank are a range behind it."""

    def __init__(self, part: dict[int, int], born: dict[int, int], labels: list[int]):
        self.born, self.made, self.at, self.end = born, {}, {}, {}
        for n in labels:
            if n in part:
                self.made.setdefault(part[n], []).append(n)
        for k in self.made.values():
            k.sort(key=lambda n: -born[n])
        todo, walk = [n for n in reversed(labels) if n not in part], []
        while todo:
            n = todo.pop()
            self.at[n] = len(walk)
            walk.append(n)
            todo += reversed(self.made.get(n, ()))
        for n in reversed(walk):
            self.end[n] = self.end[self.made[n][-1]] if n in self.made else self.at[n] + 1

    def range(self, label: int, rank: int) -> tuple[int, int]:
        """The label and what was made of it at ``rank`` or later."""
        made = self.made.get(label, ())
        n = bisect.bisect_right(made, -rank, key=lambda k: -self.born[k])
        return self.at[label], self.end[made[n - 1]] if n else self.at[label] + 1


class Automaton:
    """The compiled table. Arc b of the state behind a is missing where ``cells[page[row[a] + part] + place]`` is 1, part and place being b's column by pages; the last row is the start, which lacks none.

    ``trie``: by node the next nodes by symbol; ``inner`` and ``final``: each node's (label, part, place) inside and at the end of a word, or None."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "</w>"):
        g = Gadgets(vocab, merges)
        self.labels = {i: s for s, i in vocab.items()}
        alive = sorted(g.born)
        ends = {t for t in alive if self.labels[t].endswith(suffix)}
        states = [t for t in alive if t not in ends]
        rows, columns = Numbering({t: g.right[t] for t in states if t in g.right}, g.born, states), Numbering({t: g.left[t] for t in alive if t in g.left}, g.born, alive)
        wide = -(-len(alive) // PAGE)
        cleared = np.array([(*rows.range(u, rank + 1), *columns.range(v, rank)) for (u, v), rank in g.split.items()], np.int32).reshape(-1, 4)
        cleared = cleared[np.argsort(cleared[:, 0], kind="stable")]
        del g
        known: dict[bytes, int] = {}
        self.page = array("I")
        tallest = int((cleared[:, 1] - cleared[:, 0]).max()) if len(cleared) else 0
        for top in range(0, len(states) + 1, ROWS):
            block = np.zeros((min(ROWS, len(states) + 1 - top), wide * PAGE), bool)
            for r0, r1, c0, c1 in cleared[np.searchsorted(cleared[:, 0], top - tallest) : np.searchsorted(cleared[:, 0], top + ROWS)].tolist():
                block[max(0, r0 - top) : max(0, r1 - top), c0:c1] = True
            raw = block.tobytes()
            self.page.extend([known.setdefault(raw[k : k + PAGE], len(known)) * PAGE for k in range(0, len(raw), PAGE)])
        self.cells = b"".join(known)
        self.start = len(states) * wide
        self.row = {t: rows.at[t] * wide for t in states}
        self.trie: list[dict[int, int]] = [{}]
        self.length = {t: len(self.labels[t]) for t in states}
        self.longest = max(map(len, self.labels.values()))
        self.inner, self.final = [None], [None]
        codes = {s: b for b, s in enumerate(byte_symbols())}
        for t in alive:
            node, last = 0, t in ends
            for c in self.labels[t][: -len(suffix)] if last else self.labels[t]:
                node = self.trie[node].setdefault(codes[c], len(self.trie))
                if node == len(self.trie):
                    self.trie.append({})
                    self.inner.append(None)
                    self.final.append(None)
            (self.final if last else self.inner)[node] = (t, *divmod(columns.at[t], PAGE))

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word."""
        s = word.encode("utf-8", "surrogatepass")
        n, trie, inner, final, page, cells, row = len(s), self.trie, self.inner, self.final, self.page, self.cells, self.row
        end, begun = -1, 0
        last = [-1] * n  # the label that ends at each position of the one path there
        for at in range(n):
            if at and last[at] < 0:  # a symbol that the vocabulary lacks
                break
            base, node, stop = row[last[at]] if at else self.start, 0, at
            for symbol in s[at : at + self.longest]:
                node = trie[node].get(symbol)
                if node is None:
                    break
                stop += 1
                if stop < n:
                    label = inner[node]
                    if label is not None and last[stop] < 0 and not cells[page[base + label[1]] + label[2]]:
                        last[stop] = label[0]
                elif end < 0 and (label := final[node]) is not None and not cells[page[base + label[1]] + label[2]]:
                    end, begun = label[0], at
        if end < 0:
            raise ValueError(f"no path for {word[:80]!r}")
        path, lengths = [end], self.length
        while begun:
            t = last[begun]
            path.append(t)
            begun -= lengths[t]
        path.reverse()
        return path


class Words(dict):
    """Word -> ids; it starts anew when full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> list[int]:
        out = self.automaton.encode_word(word)
        if len(word) < 64:
            if len(self) >= WORDS:
                self.clear()
            self[word] = out
        return out


class Tokenizer:
    """Encodes and decodes as the public tokenizer file says."""

    def __init__(self, spec: str):
        given = json.loads(spec)
        if given.get("normalizer") != NORMALIZER or given.get("pre_tokenizer") != PRE_TOKENIZER:
            raise ValueError("this tokenizer file normalises or splits texts otherwise than is written out here")
        model = given["model"]
        self.automaton = Automaton(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.words = Words(self.automaton)
        self.special = {x["content"]: x["id"] for x in given["added_tokens"]}
        self.labels = self.automaton.labels | {i: s for s, i in self.special.items()}
        self.numbers = {i: str(i) for i in self.labels}
        self.at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT)

    def parts(self, text: str) -> list[str]:
        """The words of a text, normalised."""
        text = unicodedata.normalize("NFC", text)
        split = self.split
        try:
            text.encode("latin-1")  # a copy of its bytes where it holds no character beyond; such texts have nothing rare
        except UnicodeEncodeError:
            if RARE.search(text):
                text, split = text.translate(SMALL), RARE_SPLIT
            if "Σ" in text:  # str.lower() looks at a final sigma's neighbours; the file's normaliser takes single characters
                return split.findall("".join([c.lower() for c in text]))
        return split.findall(text.lower())

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        look = self.words.__getitem__
        if not any(map(text.__contains__, self.special)):
            return list(chain.from_iterable(map(look, self.parts(text))))
        out = []
        for k, part in enumerate(self.at.split(text)):
            out += [self.special[part]] if k % 2 else chain.from_iterable(map(look, self.parts(part)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids; unknown ids are left out, as by the library."""
        labels = self.labels
        return " ".join([labels[i] for i in ids if i in labels])

    def written(self, ids: list[int]) -> str:
        """The ids in decimal, joined by spaces."""
        numbers = self.numbers
        return " ".join([numbers[i] for i in ids])


_made: dict[str, Tokenizer] = {}


def tokenizer(spec: str) -> Tokenizer:
    """The tokenizer of a file's contents; the driver keeps the last one."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Tokenizer(spec)
    return _made[key]


def _sent(df: DataFrame, path: str):
    """The compiled tokenizer of the file, which the driver reads, as a broadcast of about 20 MB (bounded by the vocabulary, not by the data)."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(Tokenizer(f.read()))  # not kept by the driver


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ids array<int> of every text. path: the tokenizer file."""
    sent = _sent(docs, path)

    def run(batches):
        t = sent.value
        for b in C.slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([t.encode(x.as_py()) for x in b.column(0)], pa.list_(pa.int32()))], [*keep, "ids"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) + "ids array<int>"
    return docs.select(F.col(text).alias("__text"), *keep).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    sent = _sent(encoded, path)

    def run(batches):
        t = sent.value
        for b in C.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(x.as_py() or []) for x in b.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded; digests only."""
    sent = _sent(docs, path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches):
        t = sent.value
        for b in C.slices(batches):
            n, a, d = [], [], []
            for x in b.column(1):
                ids = t.encode(x.as_py())
                n.append(len(ids))
                a.append(sha(t.written(ids)))
                d.append(sha(t.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every whole text of documents."""
    return round_trip(C.table(spark, sf_dir, "documents"), default_path())

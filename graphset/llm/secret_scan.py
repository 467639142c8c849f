"""Secret scan: candidates by form, false positives removed by a random forest.

A candidate is a run of at least 12 of the characters A-Z a-z 0-9 + / _ . - that holds a digit, one of at least 16 that often
changes from small letters to capitals, a key of an issued format inside a run, the password of a URL, a private key in PEM
form, or a value without white space that is assigned to a credential's name, whatever its length and characters.  Its
features are its length, the make-up of its characters and how often their kind changes, how much likelier its transitions from
character to character are among secrets, how far words of a dictionary cover it, by which form it was found, the path (here:
the source) of the text, and how much likelier the words before and behind it are beside secrets.  What is likelier is learned
from the labelled findings too, as counts of transitions and of hashed words; for training, each half of the findings takes
them from the other half.  The forest is then sent to Spark's tasks, where whole texts are scanned, or rewritten, in one pass.

Labelled findings are a table (candidate, before, after, path, label); ``secret_findings`` has one, made by rule.  Training
reads at most ``max_labelled`` findings (a documented bound), in the order of a hash.

Defined cases: null and empty texts hold no candidates; a null path has no telling words; long texts are scanned whole, in
time in proportion to their length; without labelled findings of both kinds nothing is called a secret; rows alike are
scanned each on its own; ids may be null; an empty table gives an empty result.  Other columns, whatever their names, are kept
and not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled findings that training reads at most, trees, their depth, and the share of trees that must agree.
MAX_LABELLED, TREES, DEPTH, THRESHOLD = 5_000, 40, 10, 0.5
LEAST_LENGTH, LEAST_LETTERS, CONTEXT = 12, 16, 32
#: Words that names and placeholders are made of; names of credentials; words around what is no secret; telling paths.
DICTIONARY = frozenset("account add address admin api auth bar cache change changeme connection context core device engine event factory field filter foo handler here http input insert key manager map module network node none not null output parser password port process proxy put record replace result role route schema secret status store stream token window worker account admin alpha author beta build change class client cloud code config copy data date default demo dev document dummy email example file first foo form group hello host image index item label last line link list local mail main model name number object order page part path place prod product project public query release report request resource response root sample server service session site size source staging stage start state string style system table task team temp template test text time title type update user value version view web website word world year your".split())
CREDENTIAL = re.compile(r"(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|passphrase|pass(?![a-z])|pwd|auth|bearer|credential|private[_-]?key|client[_-]?secret)[\w-]*[\"']?\s*(?:=>|:=|=|:|\sis\s|\s)\s*[\"']?$", re.I)
NO_SECRET = re.compile(r"\b(?:sha\d*|md5|commit|checksum|digest|hash|uuid|guid|isbn|doi|revision|version|example|sample|placeholder|dummy)\b", re.I)
NO_SECRET_PATH = re.compile(r"test|example|sample|fixture|mock|doc|lock|min\.|vendor|dist", re.I)
ISSUED = re.compile(r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}|glpat-[0-9A-Za-z_-]{20,})$")
ISSUED_INSIDE = re.compile(rf"(?<![0-9A-Za-z])(?:{ISSUED.pattern[1:-1]})(?![0-9A-Za-z])")
#: What a text with an issued key, and one with a credential's name, must hold.
ISSUED_MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "sk_live_", "glpat-")
NAME_MARKS = ("key", "secret", "token", "pass", "pwd", "auth", "bearer", "credential")
ASSIGNED = re.compile(r"(?:api[_-]?key|access[_-]?key|secret(?!ar)|token|passw(?:or)?d|passphrase|pass(?![a-z])|pwd|auth(?!or)|bearer|credential|private[_-]?key)[\w-]{0,40}[\"']?(?:[ \t]{0,8}(?:=>|:=|=|:)[ \t]{0,8}|[ \t]is[ \t])(?:\"([^\s\"]+)\"|'([^\s']+)'|((?:[^\s\"'<>(){}\[\],;&]|&(?!\w+=))+)(?![(\[{]))", re.I)
USERINFO = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s:@/\"'<>]{0,128}:([^\s@/\"'<>]{1,256})@")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?)-----(?:[^-]*(?:-(?!----)[^-]*)*-----END \1-----|(?:\s*[A-Za-z0-9+/=]{16,})*)")
PLACEHOLDER = re.compile(r"^(?:[$%<{].*|\*+|x+|\.+|none|null|true|false|undefined|redacted|changeme)$|your|example|dummy|sample|here$|replace|insert", re.I)
MAIL_HOST = re.compile(r"^@[\w-]+(?:\.[\w-]+)+")

#: Characters that transitions are told apart by (printable ASCII, and all else as one), and buckets of words around.
LETTERS, TERMS = 96, 1 << 12
_WORD = re.compile(r"[a-z]+")

_RUN = np.zeros(256, dtype=bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.-"]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SMALL, _CAPITAL = (np.array([a <= i <= b for i in range(256)]) for a, b in ((97, 122), (65, 90)))


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * log2(c / n) for c in Counter(s).values()) if n else 0.0


def kind_of(ch: str) -> int:
    return 0 if ch.isdigit() else 1 if ch.islower() else 2 if ch.isupper() else 3


def covered(s: str) -> float:
    """Share of the characters that the dictionary's words cover, longest word first."""
    low, done = s.lower(), 0
    i = 0
    while i < len(low):
        n = next((n for n in range(min(9, len(low) - i), 2, -1) if low[i : i + n] in DICTIONARY), 0)
        done += n
        i += n or 1
    return done / max(len(s), 1)


def transitions(candidate: str) -> np.ndarray:
    """Pairs of neighbouring characters, as numbers."""
    at = np.clip(np.frombuffer(candidate.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) - 32, 0, LETTERS - 1)
    return at[:-1] * LETTERS + at[1:]


def words_around(before: str, after: str) -> tuple[list[int], list[int]]:
    """Buckets of the words before (the last one first) and behind."""
    sides = [_WORD.findall(x.lower()) for x in (before, after)]
    return [crc32(w.encode()) % TERMS for w in reversed(sides[0])], [crc32(w.encode()) % TERMS for w in sides[1]]


class Likelier:
    """Logarithms of how much likelier transitions and words around are with secrets than with other candidates."""

    def __init__(self, findings: list[tuple[str, str, str, bool]]):
        pairs, before, behind = np.ones((2, LETTERS * LETTERS)) / 8, np.ones((2, TERMS)), np.ones((2, TERMS))
        count = [2, 2]
        for candidate, b, a, secret in findings:
            y = int(secret)
            count[y] += 1
            np.add.at(pairs[y], transitions(candidate), 1 / max(1, len(candidate) - 1))
            for table, words in zip((before, behind), words_around(b, a), strict=True):
                table[y, list(set(words))] += 1
        self.pairs = np.log(pairs[1] / pairs[1].sum()) - np.log(pairs[0] / pairs[0].sum())
        self.before, self.behind = (np.log(x[1] / count[1]) - np.log(x[0] / count[0]) for x in (before, behind))

    def features(self, candidate: str, before: str, after: str) -> list[float]:
        pairs = self.pairs[transitions(candidate)]
        left, right = words_around(before, after)
        return [float(pairs.mean()) if len(pairs) else 0.0, float(self.before[left[0]]) if left else 0.0, float(self.before[left].sum()) if left else 0.0, float(self.behind[right].sum()) if right else 0.0]


class Forest(list):
    """Trees as nested (feature, threshold, left, right) with 0 or 1 at the leaves, and what their last features come from."""

    def __init__(self, trees: list, likelier: Likelier):
        super().__init__(trees)
        self.likelier = likelier


def features(candidate: str, before: str, after: str, path: str | None, likelier: Likelier) -> list[float]:
    kinds = [kind_of(c) for c in candidate]
    n = len(candidate)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    pieces = re.split(r"[^0-9A-Za-z]+", candidate)
    named = ASSIGNED.search(before + candidate[:64] + after[:1])
    named = named is not None and named.start(named.lastindex) == len(before)
    return [
        float(n),
        *(kinds.count(k) / n for k in range(4)),
        changes / n,
        entropy(candidate),
        sum(c in "0123456789abcdefABCDEF" for c in candidate) / n,
        len(set(candidate)) / n,
        covered(candidate),
        float(len(pieces)),
        max(map(len, pieces)) / n,
        float(PLACEHOLDER.search(candidate) is not None),
        float(ISSUED.search(candidate) is not None),
        float(candidate.startswith("-----BEGIN ")),
        float(USERINFO.search(before + candidate[:256] + after[:1]) is not None and after[:1] == "@"),
        float(named or CREDENTIAL.search(before) is not None),
        float(before.rstrip().endswith(("=", ":", '"', "'"))),
        float(before.endswith(('"', "'")) and after[:1] in ('"', "'")),
        float(before.endswith("=")),
        float(before.endswith("$")),
        float(MAIL_HOST.search(after) is not None),
        float(after[:1] == "("),
        float(NO_SECRET.search(before) is not None or NO_SECRET.search(after) is not None),
        float(NO_SECRET_PATH.search(path or "") is not None),
        float((path or "").count("/")),
        *likelier.features(candidate, before, after),
    ]


def formed(text: str) -> list[tuple[int, int]]:
    """(start, stop) of what the form around or inside marks: private keys, URL passwords, issued keys, assigned values."""
    out = []
    if "PRIVATE KEY" in text:
        out += [m.span() for m in PEM.finditer(text)]
    if "://" in text:
        out += [m.span(1) for m in USERINFO.finditer(text)]
    if any(x in text for x in ISSUED_MARKS):
        out += [m.span() for m in ISSUED_INSIDE.finditer(text)]
    low = text.lower()
    if any(x in low for x in NAME_MARKS):
        for m in ASSIGNED.finditer(text):
            a, b = m.span(m.lastindex)
            while m.lastindex == 3 and b > a and text[b - 1] in ".:":
                b -= 1
            if b > a:
                out.append((a, b))
    return out


def candidates(text: str | None) -> list[tuple[int, int]]:
    """(start, stop) of the candidates of a whole text, in characters; of those that overlap the first found stays."""
    if not text:
        return []
    kept: list[tuple[int, int]] = []
    # forms come first, in their order, then runs
    for a, b in [*formed(text), *runs(text)]:
        at = bisect_left(kept, (a, b))
        if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or kept[at][0] >= b):
            kept.insert(at, (a, b))
    return kept


def runs(text: str) -> list[tuple[int, int]]:
    """(start, stop) of the long runs that hold a digit, and of longer ones that mix small letters and capitals."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    run = np.concatenate([[False], _RUN[data], [False]])
    edge = np.flatnonzero(run[1:] != run[:-1])
    start, stop = edge[::2], edge[1::2]
    size = stop - start
    some = size >= LEAST_LENGTH
    start, stop, size = start[some], stop[some], size[some]
    if not len(start):
        return []
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    rises = np.concatenate([[0, 0], np.cumsum(_SMALL[data[:-1]] & _CAPITAL[data[1:]])])
    good = (digits[stop] > digits[start]) | ((size >= LEAST_LETTERS) & (rises[stop] - rises[start + 1] >= 3))
    if not good.any():
        return []
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out = []
    for a, b in zip(chars[start[good]].tolist(), chars[stop[good]].tolist(), strict=True):
        while a < b and text[a] in ".:-/@":
            a += 1
        while b > a and text[b - 1] in ".:-/@":
            b -= 1
        if b - a >= LEAST_LENGTH:
            out.append((a, b))
    return out


def around(text: str, a: int, b: int) -> tuple[str, str]:
    """What stands before and behind a candidate on its line."""
    return text[max(0, a - CONTEXT) : a].rpartition("\n")[2], text[b : b + CONTEXT].partition("\n")[0]


def fit_forest(findings: DataFrame, max_labelled: int = MAX_LABELLED, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """The forest; without findings of both labels one without trees."""
    known = findings.filter("candidate IS NOT NULL AND length(candidate) > 0 AND label IS NOT NULL").dropDuplicates(["candidate", "before", "label"])
    half = [known.filter(F.col("label") == y).orderBy(F.xxhash64("candidate", "before"), "candidate", "before").limit(max_labelled // 2) for y in (0.0, 1.0)]
    # at most max_labelled rows
    rows = [(r.candidate, r.before or "", r.after or "", r.path, r.label > 0) for r in half[0].union(half[1]).select("candidate", "before", "after", "path", "label").collect()]
    sides = [[(c, b, a, y) for i, (c, b, a, _, y) in enumerate(rows) if i % 2 == side] for side in (0, 1)]
    whole = Likelier(sides[0] + sides[1])
    if len({r[4] for r in rows}) < 2:
        return Forest([], whole)
    other = [Likelier(sides[1]), Likelier(sides[0])]
    table = findings.sparkSession.createDataFrame([(float(y), features(c, b, a, p, other[i % 2])) for i, (c, b, a, p, y) in enumerate(rows)], "label double, f array<double>").coalesce(1)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, featureSubsetStrategy="sqrt").fit(table.select("label", array_to_vector("f").alias("features")))

    def walk(node) -> tuple | int:
        if node.subtreeDepth() == 0:
            return int(node.prediction())
        split = node.split()
        return split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild())

    return Forest([walk(t.rootNode()) for t in model._java_obj.trees()], whole)


def vote(forest: Forest, f: list[float]) -> float:
    """The share of trees that call it a secret."""
    yes = 0
    for tree in forest:
        while not isinstance(tree, int):
            feature, threshold, left, right = tree
            tree = left if f[feature] <= threshold else right
        yes += tree
    return yes / len(forest) if forest else 0.0


def secrets(text: str | None, path: str | None, forest: Forest, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(start, stop, kind, score) of the secrets of a whole text."""
    out = []
    for a, b in candidates(text) if forest else []:
        before, after = around(text, a, b)
        score = vote(forest, features(text[a:b], before, after, path, forest.likelier))
        if score >= threshold:
            named = CREDENTIAL.search(before)
            kind = "issued_key" if ISSUED.search(text[a:b]) else "private_key" if text.startswith("-----BEGIN ", a) else "url_password" if after[:1] == "@" else re.sub(r"[\W\d]+", "", named.group(0)).lower() if named else "unnamed"
            out.append((a, b, kind, score))
    return out


def scan_secrets(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """id, start, stop (characters), kind, score of each secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *s) for i, text, path in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True) for s in secrets(text, path, forest, threshold)]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "start", "stop", "kind", "score"])

    found = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(path_col).cast("string")).mapInArrow(run, "id long, start int, stop int, kind string, score double")
    return found.withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str = "source", mask: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each secret replaced by ``mask``; all rows and columns stay."""
    names = docs.columns
    at, path_at = names.index(text_col), names.index(path_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, path in zip(batch.column(at).to_pylist(), batch.column(path_at).to_pylist(), strict=True):
                for a, b, _, _ in reversed(secrets(text, path, forest, threshold)):
                    text = text[:a] + mask + text[b:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names=names)

    return docs.mapInArrow(run, docs.schema)

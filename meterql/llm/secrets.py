r"""Secret scans: patterns propose, a random forest removes false positives.

Candidates are cast wide: values given to a name that sounds like a credential,
passwords in addresses, runs of 16 and more of `[A-Za-z0-9+/_-]` with a digit
(so card numbers, commit ids, checksums and paths are candidates too), and
private-key blocks. Each, blocks as well, becomes a row of features: length,
character classes and transitions, coverage by dictionary words, its path and
the words beside it; the forest alone says which are secrets. It is trained on
the driver from labelled findings, a bounded set (`LABELLED` of them unless
others are given): this module writes them from templates of leaked credentials
and of what scanners take for them, since the tables bring no labelled findings.
The tests judge it on lines that no template wrote.

The dictionary is read from a public vocabulary file (`words_path`): its whole
lower-case words, some twenty thousand. Transitions are learnt from the same words.

Defined edge cases: null and empty texts have no findings; texts and candidates of
any length are looked at whole; equal candidates in one text are findings of their own;
overlapping candidates merge into one; a score equal to the threshold is a secret;
repeated rows and rows without an id each get a row; other columns are not read,
whatever their names, and redact() returns them as they are; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterql.llm.common import by_rows, release

LABELLED, TREES, DEPTH, LEAF, THRESHOLD = 8000, 40, 10, 4, 0.5
WORDS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BESIDE = 48  # characters of the neighbourhood that are looked at
MASK = "[SECRET]"

#: Names that credentials are given to.
NAMES = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "access_key", "auth", "credential", "private_key", "client_secret")
#: Words beside strings that only look like credentials.
BENIGN = ("commit", "sha", "md5", "checksum", "digest", "revision", "uuid", "guid", "hash", "etag", "integrity", "fingerprint", "card", "order", "invoice", "phone", "isbn", "build", "version", "blob", "tree", "object")
#: What stands in a value that nobody uses.
PLACEHOLDERS = ("example", "xxxx", "your", "dummy", "change", "sample", "placeholder", "todo", "insert", "replace", "test", "fake", "none", "null", "undefined", "1234", "abcd", "redacted", "****", "${", "{{", "<")
#: How issued credentials begin.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "eyJ", "SG.", "glpat-", "-----BEGIN")
PATHS = ("test", "example", "doc", "fixture", "mock", "sample", "spec")
#: Words that the templates are filled with.
WORDS = tuple("""account action active address amount answer application author backup balance batch before block board border branch browser buffer cache
channel character client cloud cluster column comment common company component config connection console content context control country current customer
data device digest directory display document domain driver element engine event export factory field filter folder force format frame friend general global
group handler header height history host image index info input install interface internal item label language layout length level library limit list local
location logger machine manager master member memory message method model module monitor name network normal number object offset option order output package
page parent people person place player point policy position power process product profile program project property public query question queue random range
record region release remote render report resource response result return river round route sample schema school screen script search section select server
service session short simple site size small socket source space special spring stack start state status storage store stream string style summer support
switch system table target task team template theme thread time title tool total trace track transfer tree type unit update upload user value version video
view volume water week white window word work world write year""".split())

_VALUE = re.compile(r"(?i)(?:" + "|".join(n.replace("_", "[_-]?") for n in NAMES) + r""")[\w-]{0,24}["']?\s{0,3}(?:[:=]|=>|:=)\s{0,3}["']?([^\s"'`,;()<>]{8,})""")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_ADDRESS = re.compile(r"[a-z0-9+]://[^\s:/@]*:([^\s/@]+)@")
#: Between the marks: headers (Proc-Type, DEK-Info), lines of base64, quotes around them, line ends as such or escaped.
_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,\\\"']|-(?!----))*+-----END [A-Z ]{0,32}PRIVATE KEY-----")


class Dictionary:
    """Whole words of a vocabulary file (lines of a base64 piece and its rank; words begin with a space), and the transitions in them."""

    SHORTEST, LONGEST = 4, 14

    def __init__(self, words: Iterable[str]) -> None:
        self.words = frozenset(w for w in words if self.SHORTEST <= len(w) <= self.LONGEST)
        counts: Counter[str] = Counter()
        for w in sorted(self.words):
            counts.update(w[i : i + 2] for i in range(len(w) - 1))
        before: Counter[str] = Counter()
        for pair, n in counts.items():
            before[pair[0]] += n
        letters = "abcdefghijklmnopqrstuvwxyz"
        self.transitions = {a + b: math.log2((counts[a + b] + 0.1) / (before[a] + 2.6)) for a in letters for b in letters}

    def covered(self, low: str) -> int:
        """Characters that words cover, the longest word first at each place."""
        at = total = 0
        while at <= len(low) - self.SHORTEST:
            for n in range(min(self.LONGEST, len(low) - at), self.SHORTEST - 1, -1):
                if low[at : at + n] in self.words:
                    at, total = at + n, total + n
                    break
            else:
                at += 1
        return total


@lru_cache(2)
def dictionary(path: str = WORDS_PATH) -> Dictionary:
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return Dictionary(p[1:].decode() for p in pieces if p[:1] == b" " and p[1:].isalpha() and p[1:].islower() and p.isascii())


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all candidates; overlapping ones are merged, the first kind stays."""
    if not text:
        return []
    found = [(m.start(), m.end(), "block") for m in _BLOCK.finditer(text)] if "PRIVATE KEY-----" in text else []
    found += [(*m.span(1), "value") for m in _VALUE.finditer(text)]
    found += [(*m.span(1), "address") for m in _ADDRESS.finditer(text)] if "://" in text else []
    found += [(*m.span(), "run") for m in _RUN.finditer(text) if any(c.isdigit() for c in m[0])]
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, kind))
    return out


def _classes(text: str) -> list[int]:
    return [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in text]


FEATURES = ("length", "entropy", "lower", "upper", "digits", "others", "class_changes", "transition", "coverage", "hex", "longest_run", "distinct", "name_beside",
            "benign_beside", "assigned", "quoted", "path", "placeholder", "prefix", "only_digits", "slashes", "in_address")


def features(value: str, left: str, right: str, path: str | None, words: Dictionary | None = None) -> list[float]:
    words = words or dictionary()
    n, kinds, low = len(value), _classes(value), value.lower()
    counts = [k / n for k in Counter(value).values()]
    known = [words.transitions[s] for s in (low[i : i + 2] for i in range(n - 1)) if s in words.transitions]
    run = longest = 1
    for a, b in zip(value, value[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    near, where = left.lower(), (path or "").lower()
    tail = near.rstrip(" \"'")
    beside = {w for side in (near, right.lower()) for w in re.findall("[a-z]+", side) + re.findall("[a-z]+\\d", side)}
    return [
        float(n), -sum(p * math.log2(p) for p in counts), *(kinds.count(k) / n for k in range(4)),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1), sum(known) / len(known) if known else -8.0,
        words.covered(low) / n, float(all(c in "0123456789abcdef-" for c in low)), float(longest), len(counts) / n,
        float(any(w in near if len(w) > 5 else w in beside for w in NAMES)), float(not beside.isdisjoint(BENIGN)), float(tail.endswith(("=", ":", "=>"))),
        float(left[-1:] in ("'", '"') and right[:1] == left[-1:]), float(any(w in where for w in PATHS)), max((len(w) for w in PLACEHOLDERS if w in low), default=0) / n,
        float(value.startswith(PREFIXES)), float(value.isdigit()), low.count("/") / n, float(right[:1] == "@" and "://" in near),
    ]


@dataclass(frozen=True)
class Finding:
    value: str
    left: str
    right: str
    path: str
    label: int


def labelled_findings(n: int = LABELLED, seed: int = 11) -> list[Finding]:
    """Findings from templates: half are leaked credentials, half what patterns mistake for them."""
    rng = random.Random(seed)
    hexes, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    prose = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(4)))
    paths = ["src/main.py", "config/prod.env", "deploy/app.yml", "notes", "forum", "", "tests/fixture.json", "docs/example.md"]
    block = lambda body: "-----BEGIN " + rng.choice(["", "RSA ", "EC ", "OPENSSH "]) + "PRIVATE KEY-----\n" + body + "\n-----END PRIVATE KEY-----"
    out = []
    for k in range(n):
        label, path, quote = k % 2, rng.choice(paths), rng.choice(['"', '"', "'", ""])
        given = rng.choice([" = ", "=", ": ", ":", " => "])
        name = rng.choice(NAMES)
        name = rng.choice([name, name.upper(), "my_" + name, name + "_1"])
        if label:
            value = rng.choice([
                lambda: draw(hexes, rng.choice([32, 40, 40, 64])), lambda: draw(base, rng.randrange(20, 60)), lambda: "AKIA" + draw(base[:26] + "234567", 16),
                lambda: "ghp_" + draw(base, 36), lambda: "sk_live_" + draw(base, 24), lambda: "xoxb-" + draw("0123456789", 11) + "-" + draw(base, 24),
                lambda: "eyJ" + draw(base + "-_", 60), lambda: draw(base + "+/", 43) + "=", lambda: draw(base + "!@#$%^&*", rng.randrange(10, 20)),
                lambda: rng.choice("0123456789") * rng.randrange(8, 41),  # a weak one leaks as well
                lambda: rng.choice(WORDS).title() + rng.choice("!#$%&*") + draw("0123456789", 4) + draw(base, 3),
                lambda: block(rng.choice(["", "MII"]) + "\n".join(draw(base + "+/", rng.choice([4, 6, 40, 64, 64])) for _ in range(rng.choice([1, 1, 2, 4, 20]))) + rng.choice(["", "\n" + draw(base, 3) + "="])),
            ])()
            issued = value.startswith(PREFIXES)
            left = prose() + " " + (name + given if not issued or rng.random() < 0.6 else "") + quote
            if not issued and rng.random() < 0.05:
                left, quote = prose() + " " + rng.choice(["postgres", "https", "amqp", "redis"]) + "://" + rng.choice(WORDS) + ":", "@" + rng.choice(WORDS)
            path = rng.choice(paths[:6]) if rng.random() < 0.9 else path
        else:
            kind = rng.randrange(12)
            word = lambda: rng.choice(WORDS)
            if kind == 0:
                value, left = draw(hexes, rng.choice([32, 40, 64])), prose() + " " + rng.choice(BENIGN[:11]) + rng.choice([" ", ": ", "=", " = "]) + quote
            elif kind == 1:
                value, left = "-".join(draw(hexes, j) for j in (8, 4, 4, 4, 12)), prose() + " " + rng.choice(["id", "uuid", "guid", "request"]) + given + quote
            elif kind == 2:
                value, left = rng.choice(["your_" + word() + "_here", "EXAMPLE" + draw(base, 12), "x" * rng.randrange(12, 40), "changeme" + draw("0123456789", 4), "<" + word() + ">", "${" + word().upper() + "_TOKEN}", "dummy-" + word() + "-1234", "test" + draw("0123456789", 8)]), prose() + " " + name + given + quote
            elif kind == 3:
                value, left = "_".join(word() for _ in range(rng.randrange(3, 6))) + str(rng.randrange(10)), prose() + " " + quote
            elif kind == 4:
                value, left = "".join(word().title() for _ in range(4)) + str(rng.randrange(100)), prose() + " " + quote
            elif kind == 5:
                value, left = rng.choice([draw("0123456789", rng.randrange(12, 30)), draw("0123456789", 16), rng.choice("0123456789") * rng.randrange(16, 41)]), prose() + " " + rng.choice([rng.choice(BENIGN) + " ", "", name + " " + word() + " "]) + quote
            elif kind == 6:
                value, left = "/".join(word() for _ in range(4)) + "/v" + draw("0123456789", 2), prose() + " " + rng.choice(["path", "url", "import"]) + given + quote
            elif kind == 7:
                value, left = rng.choice(["get" + word().title() + "Value", word() + "." + word() + "(" + word() + ")", "os.environ." + word(), "self." + word() + "_" + word()]), prose() + " " + name + given
            elif kind == 8:
                value, left = draw(base, rng.randrange(24, 60)), prose() + " " + rng.choice(BENIGN[:11]) + "-" + given + quote
            elif kind == 9:
                value, left = block(rng.choice(["your " + word() + " key here", "x" * 64, word() + " " + word() + " " + word(), "MIIEexample" + word() + "\n" + "A" * 40])), prose() + " " + quote
            elif kind == 10:
                value, left, quote = rng.choice(["password", "user", "changeme", "secret", word(), "${PASSWORD}", "xxxx"]), prose() + " https://" + word() + ":", "@" + word()
            else:
                value, left = "-".join(word() for _ in range(rng.randrange(3, 7))) + "-" + draw("0123456789", rng.randrange(1, 5)), prose() + " " + rng.choice(["", "https://" + word() + ".com/"])
        out.append(Finding(value, left[-BESIDE:], (quote + " " + prose())[:BESIDE], path, label))
    return out


class Forest:
    """Trees as flat arrays; node i sends a row left if x[feature] <= limit."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            pick = rng.integers(0, len(rows), len(rows))
            nodes: list[list[float]] = []
            self._grow(rows[pick], labels[pick].astype(float), depth, leaf, rng, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, leaf: int, rng: np.random.Generator, nodes: list) -> int:
        """A node as [feature or -1, limit, left, right, share of positives]."""
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y.mean()) if len(y) else 0.5])
        if depth == 0 or len(y) < 2 * leaf or y.min() == y.max():
            return at
        best = (math.inf, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y) + 1)
            cut = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= leaf) & (n[:-1] <= len(y) - leaf))
            if not len(cut):
                continue
            p, q = ones[cut] / n[cut], (ones[-1] - ones[cut]) / (len(y) - n[cut])
            gini = n[cut] * p * (1 - p) + (len(y) - n[cut]) * q * (1 - q)
            k = int(np.argmin(gini))
            if gini[k] < best[0]:
                best = (float(gini[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] < 0:
            return at
        low = x[:, best[1]] <= best[2]
        nodes[at][:2] = best[1], best[2]
        nodes[at][2] = self._grow(x[low], y[low], depth - 1, leaf, rng, nodes)
        nodes[at][3] = self._grow(x[~low], y[~low], depth - 1, leaf, rng, nodes)
        return at

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """The share of positives, averaged over the trees."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for nodes in self.trees:
            at = np.zeros(len(rows), np.int64)
            while True:
                feature = nodes[at, 0].astype(np.int64)
                inner = feature >= 0
                if not inner.any():
                    break
                low = rows[every, np.maximum(feature, 0)] <= nodes[at, 1]
                at = np.where(inner, np.where(low, nodes[at, 2], nodes[at, 3]).astype(np.int64), at)
            total += nodes[at, 4]
        return total / len(self.trees)


def train(findings: Iterable[Finding], words: Dictionary | None = None) -> Forest:
    """A forest that carries the dictionary with which its features are made."""
    found, words = list(findings), words or dictionary()
    forest = Forest(np.array([features(f.value, f.left, f.right, f.path, words) for f in found]), np.array([f.label for f in found]))
    forest.words = words
    return forest


@lru_cache(2)
def default_forest(words_path: str = WORDS_PATH) -> Forest:
    return train(labelled_findings(), dictionary(words_path))


def scan(texts: Iterable[str | None], paths: Iterable[str | None], forest: Forest) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, score) of each text's candidates, in order."""
    found, rows, out = [], [], []
    for k, (text, path) in enumerate(zip(texts, paths)):
        out.append([])
        for a, b, kind in candidates(text):
            found.append((k, a, b, kind))
            rows.append(features(text[a:b], text[max(0, a - BESIDE) : a], text[b : b + BESIDE], path, forest.words))
    for (k, a, b, kind), score in zip(found, forest.predict(np.array(rows)) if rows else ()):
        out[k].append((a, b, kind, float(score)))
    return out


def redacted(text: str, spans: Iterable[tuple[int, int]], mask: str = MASK) -> str:
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source", forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_candidates, n_secrets, findings, redacted_sha256): character spans of the secrets, end exclusive."""
    model = docs.sparkSession.sparkContext.broadcast(forest or default_forest())
    slim = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text"), (F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("path"))

    def run(texts: list[str | None], paths: list[str | None]) -> dict[str, list]:
        all_found = scan(texts, paths, model.value)
        kept = [[x for x in own if x[3] >= threshold] for own in all_found]
        return {
            "n_candidates": [len(x) for x in all_found], "n_secrets": [len(x) for x in kept],
            "findings": [[{"start": a, "end": b, "kind": kind, "score": score} for a, b, kind, score in own] for own in kept],
            "redacted_sha256": [hashlib.sha256(redacted(t or "", [x[:2] for x in own]).encode("utf-8", "surrogatepass")).hexdigest() for t, own in zip(texts, kept)],
        }

    return by_rows(slim, run, "n_candidates long, n_secrets long, findings array<struct<start:long,end:long,kind:string,score:double>>, redacted_sha256 string")


def redact(docs: DataFrame, text: str = "text", path: str | None = "source", size: str | None = "n_chars", forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every secret in text replaced by MASK, and size brought up to date; all rows and columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(forest or default_forest())

    @F.pandas_udf("string")
    def masked(texts: pd.Series, paths: pd.Series) -> pd.Series:
        found = scan(texts, paths, model.value)
        out = pd.Series([None if t is None else redacted(t, [x[:2] for x in own if x[3] >= threshold]) for t, own in zip(texts, found)], dtype=object)
        release()
        return out

    # The caller's columns stand in a struct meanwhile, so that none can clash.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = lambda c: F.col("row").getField(c)
    out = row.withColumn("masked", masked(own(text).cast("string"), own(path).cast("string") if path else F.lit(None).cast("string")))
    changed = ~F.col("masked").eqNullSafe(own(text))
    new = {text: F.col("masked"), size: F.when(changed, F.char_length("masked")).otherwise(own(size)).cast(docs.schema[size].dataType)} if size in docs.columns else {text: F.col("masked")}
    return out.select(*[new.get(c, own(c)).alias(c) for c in docs.columns])

"""Per-document text quality statistics (problem 10).

Method: gradient-boosted trees over document statistics, trained on weakly
labelled prose and structural junk and mixtures of both, with probabilities
calibrated on a hand-checked holdout (quality_holdout.py). All texts take part
in the fit: word order, bins and trees come from counts that tasks add up in
whole numbers, so the model doesn't depend on how the rows lie.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import parallelism, remove, scratch, ship, spread, table

NAMES = (
    "chars", "words", "mean_word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "lines", "mean_line_length", "line_length_spread", "ends_in_punctuation", "starts_upper", "common_share",
    "distinct_words", "letter_words", "bullet_share", "stamp_share", "label_share", "table_share", "code_share", "plain_share", "sentence_share", "loose_share", "sentence_length", "longest_word", "commas", "wrapped_share", "flow",
)
#: Texts and characters that are mixed with each other in one task, about; rows that a task of the fit holds.
BLOCK, BLOCK_CHARS, ROWS = 1000, 4_000_000, 500_000
#: Parts of one in which slopes are added up, and of a bit in which word orders are counted.
_UNIT, _FINE = 1 << 20, 10_000

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TOKEN = re.compile(r"\S+")
_BULLET = re.compile(r"\s*(?:[-*•+·‣]|\d{1,3}[.)]|\[[ xX]\]|[a-z][.)])\s+\S")
_STAMP = re.compile(r"\s*(?:\[?\d{4}-\d\d-\d\d|\[?\d\d:\d\d:\d\d|<\d+>|\w{3} +\d+ \d\d:\d\d|\[?(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b)")
_LABEL = re.compile(r"\s*[\w-]{2,16}\s*[:=]\s*(\S.*)$")
_CODE = re.compile(r"[{}$\\]|\(\)|\);|==|\+=|=>|::|^\s*(?:set|echo|copy|for|if exist|rem|var|function|dim|call|schtasks|goto|note)\b|\bThen Call\b|CreateObject|^\s*\w+ = \S|[\w)]\(['\"]|^\s*[A-Z]\S*-[A-Z]\w+ -", re.I)
_CELLS = re.compile(r"\||\t|[,;](?=\S)|\s{3,}")
_SENTENCE = re.compile(r"[^.!?;…]+(?:[.!?;…]+(?!\s|$)[^.!?;…]*)*[.!?;…]*\s*")


@lru_cache(maxsize=1 << 16)
def _of_line(token: str) -> tuple[str, bool]:
    """(the token in lower case without punctuation around it, whether it is a word). Tokens come again and again."""
    bare = token.strip(".,;:!?()\"'»«“”")
    return bare.lower(), _WORD.fullmatch(bare) is not None


@lru_cache(maxsize=1 << 16)
def _of_sentence(token: str) -> tuple[str, str] | None:
    """A letter word in lower case, whole and behind its apostrophe; None for any other token."""
    bare = token.strip(".,;:!?()\"'»«“”…¿¡")
    if _WORD.fullmatch(bare) or _WORD.fullmatch(bare.replace("-", "")):
        low = bare.lower()
        return low, low.split("'")[-1]
    return None


def _kind(line: str, words: frozenset) -> str:
    """What a line is: bullet, stamp, label, table, code or plain."""
    if _STAMP.match(line):
        return "stamp"
    if _BULLET.match(line):
        return "bullet"
    tokens = line.split()
    facts = list(map(_of_line, tokens))
    known = sum([low in words for low, _ in facts])
    letters = sum([word for _, word in facts])
    if known and letters >= 4 and letters * 2 >= len(tokens) and line.strip()[:1].isupper() and line.rstrip()[-1] in ".!?" and not re.search(r"[,;]\S+[,;]\S", line):
        return "plain"
    cells = len(_CELLS.findall(line.strip()))
    if re.match(r"[^,\s]*(?:,(?=\S)[^,]*){2,}$|[^;\s]*(?:;(?=\S)[^;]*){2,}$", line.strip()) or cells >= 2 and cells * 3 >= len(tokens) and known * 4 < len(tokens) or line.count("|") >= 2 or line.count("\t") >= 2 or len(re.findall(r"\S {3,}(?=\S)", line)) >= 2:
        return "table"
    if _CODE.search(line) and known * 8 < len(tokens) or re.match(r"\s*(?:for /|if exist|echo |set \w+=|copy \"|schtasks|rem )", line):
        return "code"
    m = _LABEL.match(line)
    if m:
        rest = m.group(1).split()
        if len(rest) < 5 or sum(t.strip(".,;:!?()\"'").lower() in words for t in rest) * 6 < len(rest):
            return "label"
    return "plain"


def _running(sentence: str, words: frozenset) -> tuple[int, int, int]:
    """(letter words, common words, other tokens) of a sentence."""
    tokens = _TOKEN.findall(sentence)
    letters = [x for x in map(_of_sentence, tokens) if x is not None]
    return len(letters), sum([low in words or tail in words for low, tail in letters]), len(tokens) - len(letters)


def _wrapped(block: list[str]) -> bool:
    """Whether the lines are one text with hard line ends: the next line's first word would not have fitted."""
    width = max(map(len, block))
    if len(block) < 2 or width < 41:
        return False
    full = sum(len(x) + 1 + len(y.split()[0]) > width - 2 for x, y in zip(block, block[1:]))
    return full * 10 >= 7 * (len(block) - 1)


def _sentences(part: str, alone: bool, words: frozenset) -> tuple[float, float, list[int]]:
    """(characters in sure running sentences, in likely ones, sentence lengths). alone: a short line by itself, which is a sentence only if it looks like a whole one."""
    strict = loose = 0.0
    lengths = []
    for s in _SENTENCE.findall(part):
        letters, common, other = _running(s, words)
        if letters < 4:
            continue
        lengths.append(letters + other)
        closed = s.rstrip(" )\"'»”")[-1:] in ".!?" and s.lstrip(" (\"'«„“¿¡")[:1].isupper()
        if letters >= other and common >= 1 and closed and letters >= (6 if alone else 4):
            strict += len(s)
            loose += len(s)
        elif letters >= other and common >= 2 and common * 8 >= letters and letters + other >= (10 if alone else 6):
            loose += len(s)
            strict += len(s) if letters + other >= 10 else 0
    return strict, loose, lengths


def statistics(text: str | None, words: frozenset) -> list[float]:
    """The figures of NAMES for one text; a null text is an empty one. `words`: common words, in lower case."""
    t = text or ""
    n = len(t)
    found = _WORD.findall(t)
    low = [w.lower() for w in found]
    every = [re.sub(r"^\s*(?:>\s?)+", "", x.rstrip("\r")) for x in t.split("\n")]
    lines = [x for x in every if x.strip()]
    sizes = np.array([len(x.strip()) for x in lines] or [0], float)
    body = max(1.0, float(sizes.sum()))
    dotted = sum(x.startswith("o ") for x in lines) * 10 >= 3 * max(1, len(lines))  # the letter as a bullet
    kinds = ["bullet" if dotted and x.startswith("o ") else _kind(x, words) for x in lines]
    times: dict[str, int] = {}
    for x in lines:
        times[x] = times.get(x, 0) + 1
    kinds = ["table" if times[x] >= 3 else k for x, k in zip(lines, kinds)]  # a line that comes again and again is no sentence
    share = {k: float(sum(s for s, x in zip(sizes, kinds) if x == k)) / body for k in ("bullet", "stamp", "label", "table", "code", "plain")}
    strict = loose = wrapped = 0.0
    lengths: list[int] = []
    held: list[str] = []
    marks = iter(kinds)
    for x in (*every, ""):
        if x.strip() and next(marks) == "plain":
            held.append(x.strip())
            continue
        if held:
            if _wrapped(held):
                wrapped += sum(map(len, held))
                parts = [(" ".join(held), False)]
            else:
                parts = [(y, len(y) < 60) for y in held]
            for part, alone in parts:
                a, b, c = _sentences(part, alone, words)
                strict, loose = strict + a, loose + b
                lengths += c
        held = []
    counts = Counter(t)  # the different characters of a text are few
    symbols = sum([k for c, k in counts.items() if not (c.isalnum() or c.isspace())])
    digits, upper = (sum([k for c, k in counts.items() if test(c)]) for test in (str.isdigit, str.isupper))
    return [
        float(n), float(len(found)), float(np.mean([len(w) for w in found])) if found else 0.0, symbols / max(1, n), digits / max(1, n), upper / max(1, n),
        float(len(lines)), float(sizes.mean()), float(sizes.std() / max(1.0, sizes.mean())), sum(x.rstrip().endswith((".", "!", "?", ";", ":", "…")) for x in lines) / max(1, len(lines)),
        sum(x.lstrip()[:1].isupper() for x in lines) / max(1, len(lines)), sum(w in words for w in low) / max(1, len(low)), len(set(low)) / max(1, len(low)),
        sum(len(w) for w in found) / max(1, n), share["bullet"], share["stamp"], share["label"], share["table"], share["code"], share["plain"],
        min(1.0, strict / body), min(1.0, loose / body), float(np.mean(lengths)) if lengths else 0.0, float(max((len(w) for w in t.split()), default=0)), t.count(",") / max(1, len(found)), min(1.0, wrapped / body), 0.0,
    ]


class Flow:
    """How usual the order of words is: the mean logarithm of the chance that a word follows the one before, all words that aren't common counting as one. Tells running text from words thrown together."""

    def __init__(self, texts: list[str], words: frozenset, counted: dict[tuple[str, str], int] | None = None):
        """counted: how often each pair stands in texts that were counted elsewhere."""
        self.words, self.chance = words, {}
        pairs = Counter(counted or {})
        for t in texts:
            pairs.update(self.pairs(t))
        before: dict[str, int] = {}
        for (a, _), n in pairs.items():
            before[a] = before.get(a, 0) + n
        kinds = len(words) + 1
        self.unseen = {a: float(np.log2(0.5 / (n + 0.5 * kinds))) for a, n in before.items()}
        self.chance = {(a, b): float(np.log2((n + 0.5) / (before[a] + 0.5 * kinds))) for (a, b), n in pairs.items()}
        self.rare = -float(np.log2(2 * kinds))

    def pairs(self, text: str):
        seq = [w if w in self.words else "" for w in map(str.lower, _WORD.findall(text))]
        return zip(seq, seq[1:])

    def of(self, text: str | None) -> float:
        logs = [self.chance.get(p) or self.unseen.get(p[0], self.rare) for p in self.pairs(text or "")]
        return float(np.mean(logs)) if logs else self.rare


def figures_of(text: str | None, words: frozenset, flow: Flow) -> list[float]:
    return [*statistics(text, words)[:-1], flow.of(text)]


class Trees:
    """Gradient-boosted regression trees with logistic loss over binned features; a depth-limited tree is three arrays. Deterministic."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 12):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.slope, self.shift = 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            size = (1 << (self.depth + 1)) - 1
            feature, limit, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            node = np.zeros(len(y), int)
            for k in range(size):
                at = np.nonzero(node == k)[0]
                if not len(at):
                    continue
                value[k] = self.rate * g[at].sum() / (h[at].sum() + 1.0)
                if k >= (1 << self.depth) - 1 or len(at) < 2 * self.least:
                    continue
                best, choice = 1e-6, None
                whole = g[at].sum() ** 2 / (h[at].sum() + 1.0)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[at, j]
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[at], h[at], np.ones(len(at))))
                    gain = gs**2 / (hs + 1.0) + (g[at].sum() - gs) ** 2 / (h[at].sum() - hs + 1.0) - whole
                    gain[(ns < self.least) | (len(at) - ns < self.least)] = -1
                    c = int(gain.argmax())
                    if gain[c] > best:
                        best, choice = gain[c], (j, c)
                if choice:
                    j, c = choice
                    feature[k], limit[k] = j, edges[j][c]
                    node[at] = np.where(binned[at, j] <= c, 2 * k + 1, 2 * k + 2)
            score += value[node]
            self.trees.append((feature, limit, value))
        return self

    def grow(self, edges: list[np.ndarray], totals: tuple[int, float], sums) -> "Trees":
        """fit() over rows that lie elsewhere. totals: their number and the sum of their labels. sums(self, tree, nodes): for these nodes of the
        tree being grown an array (node, feature, bin, 3) of the sums of slopes and curvatures, in parts of _UNIT, and of the numbers of rows."""
        mean = float(np.clip(totals[1] / totals[0], 1e-3, 1 - 1e-3))
        self.base = float(np.log(mean / (1 - mean)))
        size, inner = (1 << (self.depth + 1)) - 1, (1 << self.depth) - 1
        for _ in range(self.rounds):
            tree = feature, limit, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            cuts, nodes = np.zeros(size, int), [0]
            while nodes:
                following = []
                for k, every in zip(nodes, sums(self, (feature, cuts), nodes)):
                    g, h, n = every[:, :, 0] / _UNIT, every[:, :, 1] / _UNIT, every[:, :, 2]
                    all_g, all_h, all_n = g[0].sum(), h[0].sum(), n[0].sum()
                    if k == 0:
                        value[0] = self.rate * all_g / (all_h + 1.0)
                    if all_n < 2 * self.least:
                        continue
                    best, choice = 1e-6, None
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        gs, hs, ns = (np.cumsum(v[j])[: len(e)] for v in (g, h, n))
                        gain = gs**2 / (hs + 1.0) + (all_g - gs) ** 2 / (all_h - hs + 1.0) - all_g**2 / (all_h + 1.0)
                        gain[(ns < self.least) | (all_n - ns < self.least)] = -1
                        c = int(gain.argmax())
                        if gain[c] > best:
                            best, choice = gain[c], (j, c, gs[c], hs[c])
                    if choice:
                        j, c, left_g, left_h = choice
                        feature[k], limit[k], cuts[k] = j, edges[j][c], c
                        value[2 * k + 1] = self.rate * left_g / (left_h + 1.0)
                        value[2 * k + 2] = self.rate * (all_g - left_g) / (all_h - left_h + 1.0)
                        following += [x for x in (2 * k + 1, 2 * k + 2) if x < inner]
                nodes = following
            self.trees.append(tree)
            sums(self, (feature, cuts, value), None)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= limit[node]
                node = np.where(f < 0, node, np.where(go, 2 * node + 1, 2 * node + 2))
            out += value[node]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        """Platt's scaling on the holdout, with his smoothed targets."""
        s = self.score(x)
        up, down = y.sum(), len(y) - y.sum()
        target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
        a, b, rate = 1.0, 0.0, 0.05
        for _ in range(2000):  # gradient steps on the mean loss, held near the untouched score: a small holdout may be separable
            d = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30))) - target
            a, b = a - rate * ((d * s).mean() + 0.01 * (a - 1)), b - rate * (d.mean() + 0.01 * b)
        if a > 0.05:
            self.slope, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.score(x) + self.shift)))


def weak_label(figures: list[float]) -> int | None:
    """1 for plain prose, 0 for structural junk, None where neither is plain. Word order isn't looked at."""
    f = dict(zip(NAMES, figures))
    if f["words"] == 0 or f["sentence_share"] <= 0.05 and f["plain_share"] <= 0.3 or f["loose_share"] == 0:
        return 0
    if f["sentence_share"] >= 0.85 and f["words"] >= 20:
        return 1
    return None


def mixed(prose: list[str], junk: list[str], times: int | None, rng: np.random.Generator) -> list[tuple[str, int]]:
    """Labelled texts made of prose and of junk; `times` pairs are drawn, or else as many as it takes for each text to have its turn."""
    made = []
    for t in prose:
        if rng.integers(3) == 0:
            parts = t.split()
            rng.shuffle(parts)
            width = int(rng.integers(6, 40))
            made.append(("\n".join(" ".join(parts[i : i + width]) for i in range(0, len(parts), width)), 0))
    if prose and junk:
        turns = max(len(prose), len(junk))
        in_turn = zip(*(np.resize(rng.permutation(len(x)), turns) for x in (prose, junk)))
        drawn = in_turn if times is None else ((rng.integers(len(prose)), rng.integers(len(junk))) for _ in range(times))
        for i, j in drawn:
            a, b = prose[i], junk[j]
            share = rng.uniform(0.05, 0.95)
            # Cut the longer part so that the prose has about that share.
            a = a[: max(1, int(min(len(a), share / (1 - share) * len(b))))]
            b = b[: max(1, int(len(a) * (1 - share) / share))]
            a, b = a.rsplit(" ", 1)[0] + ".", b.rsplit("\n", 1)[0]
            real = len(a) / (len(a) + len(b))
            if abs(real - 0.5) >= 0.03:
                made.append((a + "\n" + b if rng.integers(2) else b + "\n" + a, int(real >= 0.5)))
    return made


def training_set(texts: list[str], words: frozenset, seed: int = 7) -> tuple[np.ndarray, np.ndarray, Flow]:
    """Figures and labels of plain cases and of what is made of them: mixtures of lines of prose and of junk, labelled by the
    share of characters, and prose with its words thrown together, which is junk. Also the word order of the prose."""
    rng = np.random.default_rng(seed)
    labelled = [(t, y) for t in texts if (y := weak_label(statistics(t, words))) is not None]
    prose, junk = [t for t, y in labelled if y == 1], [t for t, y in labelled if y == 0 and t.strip()]
    flow = Flow(prose, words)
    if len(prose) >= 20:
        # What has the form of prose but by far not its word order is rubbish.
        order = np.array([flow.of(t) for t in prose])
        middle = np.median(order)
        spread = np.median(np.abs(order - middle)) * 1.4826
        odd = {t for t, o in zip(prose, order) if o < middle - max(5 * spread, 0.8)}
        prose = [t for t in prose if t not in odd]
        flow = Flow(prose, words)
        labelled = [(t, 0 if t in odd else y) for t, y in labelled]
    made = [*labelled, *mixed(prose, junk, len(labelled), rng)]
    x = np.array([figures_of(t, words, flow) for t, _ in made], float).reshape(-1, len(NAMES))
    return x, np.array([y for _, y in made], float), flow


def measured(documents: DataFrame, key: str, text: str, words: frozenset) -> DataFrame:
    """(key, text, h, first, label, the figures of NAMES but the last), written once. Equal texts lie together: `first` marks one of them, and their figures are computed once."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(words)

    def run(batches):
        known, before, figures, label = shared.value, None, None, None
        for b in batches:
            out, first, labels = [], [], []
            for t in b.column(1).to_pylist():
                first.append(figures is None or t != before)
                if first[-1]:
                    before, figures = t, statistics(t, known)
                    label = weak_label(figures)
                out.append(figures)
                labels.append(label)
            x = np.array(out, float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first, pa.bool_()), pa.array(labels, pa.int32()), *(pa.array(x[:, j]) for j in range(len(NAMES) - 1))], names=[key, "text", "h", "first", "label", *NAMES[:-1]])

    rows = documents.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    lying = rows.repartition(parallelism(spark), "h").sortWithinPartitions("h", "text")
    path = scratch(spark, "measured")
    lying.mapInArrow(run, f"`{key}` long, text string, h long, first boolean, label int, " + ", ".join(f"{n} double" for n in NAMES[:-1])).write.parquet(path)
    return spark.read.parquet(path)


def _counted(texts: DataFrame, run, schema: str, by: list[str]) -> list:
    """What run counts in each task, added up. Of a bounded number of different values."""
    return texts.mapInArrow(run, schema + ", n long").groupBy(*by).agg(F.sum("n").alias("n")).collect()


def _pairs_of(prose: DataFrame, words: frozenset, keep) -> Counter:
    """How often each pair of words stands in the texts that keep() lets through."""

    def run(batches):
        flow, pairs = Flow([], words), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if keep is None or keep(t):
                    pairs.update(flow.pairs(t))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([c for _, c in pairs], pa.string()), pa.array(list(pairs.values()), pa.int64())], names=["a", "b", "n"])

    return Counter({(r["a"], r["b"]): r["n"] for r in _counted(prose, run, "a string, b string", ["a", "b"])})


def _middle(values: np.ndarray, times: np.ndarray) -> float:
    """The median of values that come so many times."""
    order = np.argsort(values)
    run = np.cumsum(times[order])
    return float(values[order][np.searchsorted(run, run[-1] / 2)])


def _word_order(prose: DataFrame, words: frozenset) -> tuple[Flow, float | None, Flow]:
    """The word order of all texts of the form of prose, the mean below which such a text is rubbish (None: none is, or too few texts to say), and the word order without these."""
    pairs = _pairs_of(prose, words, None)
    flow = Flow([], words, pairs)

    def run(batches):
        orders = Counter()
        for b in batches:
            orders.update(round(flow.of(t) * _FINE) for t in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(orders), pa.int64()), pa.array(list(orders.values()), pa.int64())], names=["o", "n"])

    found = _counted(prose, run, "o long", ["o"])
    if sum(r["n"] for r in found) < 20:
        return flow, None, flow
    values, times = np.array([r["o"] for r in found]) / _FINE, np.array([r["n"] for r in found])
    middle = _middle(values, times)
    border = middle - max(5 * _middle(np.abs(values - middle), times) * 1.4826, 0.8)
    if values.min() > border + 1 / _FINE:
        return flow, None, flow
    odd = _pairs_of(prose, words, lambda t: flow.of(t) < border)
    return flow, border, Flow([], words, pairs - odd)


def _significant(x: np.ndarray) -> np.ndarray:
    """Three digits of each figure, for counting them."""
    size = 10.0 ** (np.floor(np.log10(np.maximum(np.abs(x), 1e-9))) - 2)
    return np.round(x / size) * size


def _block(words: frozenset, shared):
    """The labelled rows of a block of texts, and what is made of them."""

    def run(part: pa.Table) -> pa.Table:
        rough, border, flow = shared.value
        part = part.sort_by([("h", "ascending"), ("text", "ascending")])
        rng = np.random.default_rng([7, part.column("block")[0].as_py()])
        texts, y = part.column("text").to_pylist(), part.column("label").to_numpy().astype(float)
        odd = np.array([border is not None and k == 1 and rough.of(t) < border for t, k in zip(texts, y)])
        prose, junk = [t for t, k, o in zip(texts, y, odd) if k == 1 and not o], [t for t, k in zip(texts, y) if k == 0 and t.strip()]
        made = mixed(prose, junk, None, rng)
        x = np.stack([*(part.column(n).to_numpy() for n in NAMES[:-1]), np.array([flow.of(t) for t in texts])], axis=1)
        x = np.concatenate([x, np.array([figures_of(t, words, flow) for t, _ in made], float).reshape(-1, len(NAMES))])
        y = np.concatenate([np.where(odd, 0.0, y), np.array([k for _, k in made], float)])
        return pa.table([pa.array(y), *(pa.array(x[:, j]) for j in range(len(NAMES)))], names=["label", *NAMES])

    return run


def _matrix(b) -> np.ndarray:
    return np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in NAMES], axis=1) if b.num_rows else np.zeros((0, len(NAMES)))


def _edges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Borders of the bins: quantiles of all rows, of figures to three digits."""

    def run(batches):
        counts = Counter()
        for b in batches:
            x = _significant(_matrix(b))
            for j in range(x.shape[1]):
                v, n = np.unique(x[:, j], return_counts=True)
                counts.update({(j, float(a)): int(k) for a, k in zip(v, n)})
        yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in counts], pa.int32()), pa.array([v for _, v in counts], pa.float64()), pa.array(list(counts.values()), pa.int64())], names=["j", "v", "n"])

    held: dict[int, list[tuple[float, int]]] = {}
    for r in _counted(rows, run, "j int, v double", ["j", "v"]):
        held.setdefault(r["j"], []).append((r["v"], r["n"]))
    out = []
    for j in range(len(NAMES)):
        found = sorted(held.get(j, []))
        run_up = np.cumsum([n for _, n in found])
        at = np.searchsorted(run_up, np.linspace(0, 1, bins + 1)[1:-1] * run_up[-1])
        out.append(np.unique(np.array([v for v, _ in found])[at]))
    return out


def _node(x: np.ndarray, feature: np.ndarray, cuts: np.ndarray, levels: int) -> np.ndarray:
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(levels):
        f = feature[node]
        node = np.where(f < 0, node, np.where(x[rows, np.maximum(f, 0)] <= cuts[node], 2 * node + 1, 2 * node + 2))
    return node


def _slopes(block, base: float, feature: np.ndarray, cuts: np.ndarray, nodes: list[int], bins: int) -> np.ndarray:
    """A block's sums for Trees.grow(), in whole numbers, so that their order is of no account."""
    x, y, score = block
    place = np.full(len(feature), -1)
    place[nodes] = np.arange(len(nodes))
    which = place[_node(x, feature, cuts, (nodes[0] + 1).bit_length() - 1)]
    x, y, score, which = (v[which >= 0] for v in (x, y, score, which))
    p = 1 / (1 + np.exp(-(score + base)))
    at = ((which[:, None] * len(NAMES) + np.arange(len(NAMES))) * bins + x).ravel()
    return np.stack([np.bincount(at, np.repeat(w, len(NAMES)), len(nodes) * len(NAMES) * bins) for w in (np.rint((y - p) * _UNIT), np.rint(p * (1 - p) * _UNIT), np.ones(len(y)))], axis=-1).reshape(len(nodes), len(NAMES), bins, 3)


def boosted(rows: DataFrame) -> Trees:
    """Trees fitted on all rows (label, NAMES), which stay where they are: a level of a tree is one pass that gives sums of bins."""
    model, context = Trees(), rows.sparkSession.sparkContext
    total, up = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    edges = _edges(rows, model.bins)

    def binned(batches):
        xs, ys = [], []
        for b in batches:
            x = _matrix(b)
            xs.append(np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8))
            ys.append(b.column("label").to_numpy(zero_copy_only=False))
        if xs:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(xs).tobytes()], pa.binary()), pa.array([np.concatenate(ys).astype(np.uint8).tobytes()], pa.binary())], names=["x", "y"])

    def opened(r):
        y = np.frombuffer(r["y"], np.uint8)
        return np.frombuffer(r["x"], np.uint8).reshape(-1, len(NAMES)), y, np.zeros(len(y))

    blocks = rows.repartition(max(context.defaultParallelism, -(-total // ROWS))).mapInArrow(binned, "x binary, y binary").rdd
    state, old = blocks.map(opened).persist(StorageLevel.MEMORY_AND_DISK), None

    def sums(trees, tree, nodes):
        nonlocal state, old
        if nodes is None:
            feature, cuts, value = tree
            old, state = state, state.map(lambda b: (b[0], b[1], b[2] + value[_node(b[0], feature, cuts, trees_depth)])).persist(StorageLevel.MEMORY_AND_DISK)
            return None
        (feature, cuts), base, bins = tree, trees.base, trees.bins
        got = state.map(lambda b: _slopes(b, base, feature, cuts, nodes, bins)).reduce(np.add)
        if old is not None:
            old.unpersist()
            old = None
        return got

    trees_depth = model.depth
    model.grow(edges, (total, up), sums)
    state.unpersist()
    if old is not None:
        old.unpersist()
    return model


def learn(figured: DataFrame, words: frozenset) -> tuple[Trees, Flow]:
    """Trees fitted on all texts of measured() with a weak label, each counted once, calibrated on the holdout. Without texts of both kinds the holdout is fitted too."""
    from lamina.llm.quality_holdout import HOLDOUT

    spark = figured.sparkSession
    texts = figured.where("first and label is not null and length(text) > 0")
    orders = _word_order(texts.where("label = 1").select("text"), words)
    flow = orders[-1]
    hx = np.array([figures_of(t, words, flow) for t, _ in HOLDOUT], float)
    hy = np.array([p for _, p in HOLDOUT], float)
    n, chars = texts.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    if not n:
        return Trees().fit(hx, hy).calibrate(hx, hy), flow
    blocks = max(-(-n // BLOCK), -(-chars // BLOCK_CHARS))
    schema, path = "label double, " + ", ".join(f"{x} double" for x in NAMES), scratch(spark, "rows")
    placed = texts.select(F.pmod("h", F.lit(blocks)).alias("block"), "h", "text", "label", *NAMES[:-1]).repartition(parallelism(spark), "block")
    placed.groupBy("block").applyInArrow(_block(words, spark.sparkContext.broadcast(orders)), schema).write.parquet(path)
    rows = spark.read.parquet(path)
    if len(rows.select("label").distinct().limit(2).collect()) < 2:
        rows = rows.unionByName(spark.createDataFrame([(float(k), *map(float, x)) for k, x in zip(hy, hx)], schema))
    model = boosted(rows).calibrate(hx, hy)
    remove(spark, path)
    return model, flow


def train(documents: DataFrame, words: frozenset, sample: int | None = None) -> tuple[Trees, Flow]:
    """Trees fitted on all texts, calibrated on the holdout; see learn(). sample: on at most so many texts instead, which a hash picks evenly and which are fitted on the driver."""
    from lamina.llm.quality_holdout import HOLDOUT

    if sample is None:
        return learn(measured(documents.select(F.lit(None).alias("id"), "text"), "id", "text", words), words)
    # The least hashes of all texts: a sample of fixed size and even, whatever the table's size; texts beyond 20,000 characters stay out of it.
    # Copies count once: the border is sought among different hashes, and only texts up to it are grouped.
    texts = documents.where("text is not null and length(text) between 1 and 20000").select("text", F.xxhash64("text").alias("h"))
    least = texts.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    picked = texts.where(F.col("h") <= F.lit(least).cast("long")).distinct().orderBy("h", "text").limit(sample)
    x, y, flow = training_set([r[0] for r in picked.collect()], words)
    hx = np.array([figures_of(t, words, flow) for t, _ in HOLDOUT], float)
    hy = np.array([p for _, p in HOLDOUT], float)
    if len(set(y.tolist())) < 2:
        x, y = np.concatenate([x, hx]), np.concatenate([y, hy])
    return Trees().fit(x, y).calibrate(hx, hy), flow


def assess(documents: DataFrame, key: str, text: str, words: frozenset, model: tuple[Trees, Flow]) -> DataFrame:
    """One row for each document: key, the figures of NAMES, prose (calibrated probability) and natural (whether it is natural prose).

    A null or empty text and one without words has its figures and is not
    natural; a key twice or null is kept as it is; other columns are left out;
    an empty table gives no rows. Texts are read whole.
    """
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((words, model))

    def run(batches):
        known, (trees, flow) = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array([figures_of(t, known, flow) for t in b.column(1).to_pylist()], float)
            p = np.where(x[:, 1] > 0, trees.probability(x), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, j]) for j in range(x.shape[1])), pa.array(p), pa.array(p >= 0.5)], names=[key, *NAMES, "prose", "natural"])

    return spread(documents.select(F.col(key).cast("long"), F.col(text))).mapInArrow(run, f"`{key}` long, " + ", ".join(f"{n} double" for n in NAMES) + ", prose double, natural boolean")


def judged(figured: DataFrame, key: str, model: tuple[Trees, Flow]) -> DataFrame:
    """assess() of the rows of measured(), whose figures are there."""
    shared = figured.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        trees, flow = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([*(b.column(n).to_numpy() for n in NAMES[:-1]), np.array([flow.of(t) for t in b.column(1).to_pylist()])], axis=1)
            p = np.where(x[:, 1] > 0, trees.probability(x), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, j]) for j in range(x.shape[1])), pa.array(p), pa.array(p >= 0.5)], names=[key, *NAMES, "prose", "natural"])

    return figured.select(key, "text", *NAMES[:-1]).mapInArrow(run, f"`{key}` long, " + ", ".join(f"{n} double" for n in NAMES) + ", prose double, natural boolean")


def common_words(spark: SparkSession, folder: str) -> frozenset:
    """The function words of all languages: a fixed table of hundreds, read with a limit it must not reach. A text's stated language may be wrong, so all count for all."""
    rows = table(spark, folder, "common_words").select(F.lower("word")).where("word is not null").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 common words")
    return frozenset(r[0] for r in rows)


def p10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, words = table(spark, folder, "documents").select("doc_id", "text"), common_words(spark, folder)
    figured = measured(docs, "doc_id", "text", words)
    return judged(figured, "doc_id", learn(figured, words))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_quality(spark, folder).where("not natural").select("doc_id")


QUERIES = {"p10_found": p10_found, "p10_quality": p10_quality}
SQL: dict[str, str] = {}

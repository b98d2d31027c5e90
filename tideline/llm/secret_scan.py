"""Secret scans: fixed shapes of credentials, and character Markov models that tell random strings from identifiers.

Base kinds are ``assign`` (a value assigned to a password-like name), ``access`` and ``hex``. The method adds ``random``:
every run of ``TOKEN`` characters of ``MIN_LENGTH`` or more, less the base spans in it, is scored under two character Markov
models of order two, one of random strings and one of ordinary identifiers; what is left of the run is a secret where the
log-likelihood ratio per character passes a threshold fitted on samples kept out of training. Where the whole doesn't pass,
its parts between = / . - _ are scored alone, and between those that pass every stretch of ``MIN_LENGTH`` or more with the
largest sum of ratios above a second threshold, fitted on the best stretches of long ordinary paths.

The models learn from labelled samples. Ordinary: words of a bounded sample of texts (outside base spans) and ``COMMON`` ones, alone and
joined the way ordinary runs are (identifiers, files, paths, hosts, addresses, versions, dates, compounds, repeats). Random: values of base
spans in that sample, and strings drawn uniformly from the alphabets keys are written in. A fifth of the words is kept out of training: runs
made of those set the thresholds. ``SAMPLE_DOCS``, ``SAMPLE_WORDS`` and ``SAMPLE_STRINGS`` bound the samples; texts are scanned whole, and no other
bound exists.

Defined results: null text is empty and has no spans; ids are never read; where the sample has no word the ordinary model
is uniform. Spans count code points, end exclusive, and are ordered by start, then kind (assign, access, hex, random).
An empty table gives an empty one; rows that repeat an id are scanned each by itself. Extra columns are ignored by ``scan`` apart from those
asked for.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

SAMPLE_DOCS = 400
SAMPLE_STRINGS = 6000
SAMPLE_WORDS = 20_000
MIN_LENGTH = 16
MIN_RATIO = 0.4
FALSE_ALARMS = 0.006
KINDS = ("assign", "access", "hex", "random")

# The shapes that the contract of this scan names.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

# Words common in addresses, files and identifiers, and file endings.
COMMON = (
    "about access account action add admin agent album alpha android api app apple archive article asset async auth backup base batch beta bin binary blog board book branch browser "
    "buffer build bundle button cache calendar callback camera cancel category change channel chapter chart check class client cloud cluster code collection column comment commit "
    "common community company component config connection contact container content context control controller copy core count country course create custom data database date "
    "debug default delete demo deploy design detail developer device dictionary directory docker document domain download driver edit editor element email engine entry environment error "
    "event example export factory feature feed field file filter firmware folder font format forum framework function gallery game general get git global graph group guide handler "
    "hardware header health help history home host html http https icon image import include index info input install instance interface internal invoice issue item java javascript job json "
    "kernel key kubernetes language latest layout library license linux list loader local lock login manager map market master media member memory menu message method mobile mode model module "
    "monitor music network news node notebook number object office online open option order output package page parser password path payment people performance photo picture pipeline platform player "
    "plugin policy portal post press price private process product profile program project protocol provider public python query queue random read readme record region register release remote report "
    "repository request resource response result review role root route router runtime sample schedule schema science school script search section security select sensor server service session setting shared "
    "shop signal simple site size software source space special stack standard start state static status storage store stream string student style support system table target task team template term "
    "test text theme thread ticket time title tool topic trade train transfer travel tree trigger type update upload user util value vendor version video view virtual wallet watch weather web website widget wiki "
    "wikipedia window wireless word work worker world write year youtube zone"
).split()
ENDINGS = (".py", ".html", ".json", ".jpg", ".png", ".pdf", ".tar.gz", ".txt", ".js", ".css", ".csv", ".xml", ".mp4", ".zip", ".md", ".yaml")

# The same matches, found faster: a failing match of these leaves nothing that a later start could match.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
_NAMES = re.compile(r"[=:]")
_WORD = re.compile(r"[A-Za-z]{3,15}")
_PART = re.compile(r"[A-Za-z0-9+]{16,}")
_CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
_CODE = np.full(128, 0, np.int64)
_CODE[[ord(c) for c in _CLASSES]] = np.arange(1, len(_CLASSES) + 1)
_SIZE = len(_CLASSES) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base kinds."""
    found = []
    if _NAMES.search(text):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), 2) for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


class Model:
    """Log-likelihood ratio per transition (last two characters, next one), and the threshold on its mean."""

    def __init__(self, ratio: np.ndarray, threshold: float, stretch: float | None = None):
        self.ratio, self.threshold = ratio.astype(np.float32), threshold
        self.stretch = threshold if stretch is None else stretch

    def score(self, token: str) -> float:
        return float(self.ratio[_transitions(token)].mean())

    def best_stretch(self, token: str) -> float:
        """The largest mean of MIN_LENGTH or more characters in a row; one of less than twice that length has it."""
        sums = np.concatenate([[0.0], np.cumsum(self.ratio[_transitions(token)], dtype=np.float64)])
        return max(float((sums[n:] - sums[:-n]).max()) / n for n in range(MIN_LENGTH, min(2 * MIN_LENGTH, len(sums))))

    def _stretches(self, token: str) -> Iterator[tuple[int, int]]:
        above = np.concatenate([[0.0], np.cumsum(self.ratio[_transitions(token)].astype(np.float64) - self.stretch)])
        todo = [(0, len(token))]
        while todo:
            low, high = todo.pop()
            if high - low < MIN_LENGTH:
                continue
            sums = above[low : high + 1]
            gain = sums[MIN_LENGTH:] - np.minimum.accumulate(sums[:-MIN_LENGTH])
            last = int(gain.argmax())
            if gain[last] <= 0:
                continue
            start, end = low + int(sums[: last + 1].argmin()), low + last + MIN_LENGTH
            todo += [(low, start), (end, high)]
            while end - start > MIN_LENGTH and token[end - 1] in ".=-_/+":
                end -= 1
            while end - start > MIN_LENGTH and token[start] in ".=-_/":
                start += 1
            yield start, end

    def random_spans(self, token: str) -> list[tuple[int, int]]:
        """(start, end) of the random strings in a run, or in a part of one."""
        whole = token.rstrip(".=-_/+")
        if len(whole) < MIN_LENGTH:
            return []
        if self.score(whole) > self.threshold:
            return [(0, len(whole))]
        parts = [m.span() for m in _PART.finditer(whole) if self.score(m.group()) > self.threshold]
        found, at = list(parts), 0
        for start, end in [*parts, (len(whole), len(whole))]:
            found += [(at + s, at + e) for s, e in self._stretches(whole[at:start])] if start - at >= MIN_LENGTH else []
            at = end
        return found

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found = base_spans(text)
        extra = []
        first, reach = 0, 0  # base spans before ``first`` end before this run; ``reach`` is the end of those passed
        for m in _TOKEN.finditer(text):
            start, end = m.span()
            while first < len(found) and found[first][1] <= start:
                first += 1
            at = max(start, reach)
            k = first
            while k < len(found) and found[k][0] < end:
                if found[k][0] - at >= MIN_LENGTH:
                    extra += [(at + s, at + e, 3) for s, e in self.random_spans(text[at : found[k][0]])]
                at = max(at, found[k][1])
                k += 1
            reach = max(reach, at)
            if end - at >= MIN_LENGTH:
                extra += [(at + s, at + e, 3) for s, e in self.random_spans(text[at:end])]
        return sorted(found + extra, key=lambda s: (s[0], s[2])) if extra else found


def _transitions(token: str) -> np.ndarray:
    c = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
    before = np.concatenate([[0, 0], c])
    return (before[:-2] * _SIZE + before[1:-1]) * _SIZE + c


def _log_chances(tokens: list[str]) -> np.ndarray:
    """Order-two transition log-chances, backed off to order one and to a uniform next character."""
    counts = np.zeros(_SIZE**3)
    for token in tokens:
        np.add.at(counts, _transitions(token), 1)
    three = counts.reshape(_SIZE, _SIZE, _SIZE)
    two = three.sum(0)
    one = (two + 2.0 / _SIZE) / (two.sum(1, keepdims=True) + 2.0)
    return np.log((three + 4.0 * one[None]) / (three.sum(2, keepdims=True) + 4.0)).ravel()


def ordinary_identifiers(words: list[str], n: int, rng: random.Random) -> list[str]:
    """Runs as people and programs write them: words joined as identifiers, files, paths and hosts are, addresses, versions, numbers,
    dates, long compounds, one character repeated. ``words`` are mixed with those that are common in such runs."""
    if not words:
        return []

    def word() -> str:
        w = rng.choice(words) if rng.random() < 0.6 else rng.choice(COMMON)
        return rng.choice((w.lower(), w.lower(), w.capitalize()))

    def number() -> str:
        return rng.choice((str(rng.randrange(10)), str(rng.randrange(100)), str(rng.randrange(10**4)), f"{rng.randrange(10**8):08d}"))

    def day(by: str = "") -> str:
        return by.join((str(rng.randint(1970, 2040)), f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 28):02d}"))

    def version() -> str:
        return rng.choice(("", "v")) + ".".join(str(rng.randrange(30)) for _ in range(rng.randint(2, 4)))

    def ending() -> str:
        return rng.choice(ENDINGS)

    def path(least: int = 1, most: int = 5) -> str:
        return "/".join(rng.choice((word, word, word, number, day))() if rng.random() < 0.9 else day("/") for _ in range(rng.randint(least, most)))

    def host() -> str:
        return rng.choice(("", "", "www.", "api.")) + rng.choice((word().lower(), word().lower() + "-" + word().lower(), word().lower() + number())) + "." + rng.choice(("com", "org", "net", "io", "de", "fr", "es", "co.uk"))

    styles = (
        lambda: "_".join(word().lower() for _ in range(rng.randint(1, 6))),
        lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 6))),
        lambda: "-".join(word().lower() for _ in range(rng.randint(1, 6))),
        lambda: rng.choice(("", "/", "./")) + path() + rng.choice(("", ending())),
        lambda: "_".join(word().upper() for _ in range(rng.randint(1, 5))) + number(),
        lambda: "".join(word().lower() for _ in range(rng.randint(2, 6))),
        lambda: ".".join(word().lower() for _ in range(rng.randint(2, 5))),
        lambda: "//" + host() + "/" + path() + rng.choice(("", ending(), "/")),
        lambda: host() + rng.choice(("", "/" + path())),
        lambda: f"{rng.choice(('', '+'))}{rng.randrange(10**9, 10**18)}",
        lambda: day(rng.choice("-/_.")) + rng.choice("-_/.") + rng.choice((number(), word().lower(), day("/"))) + rng.choice(("", ending())),
        lambda: word() + rng.choice("-_") + version() + rng.choice(("", "-rc." + number(), "-beta", "+build." + day(), "-" + word().lower())) + rng.choice(("", ending())),
        lambda: version() + rng.choice(("-rc.1", "-alpha", "")) + rng.choice(("+build.", "-")) + day(),
        lambda: rng.choice(("IMG", "DSC", "scan", "log", word())) + "_" + day() + "_" + f"{rng.randrange(10**6):06d}" + rng.choice(("", "_HDR", "_" + word())) + ending(),
        lambda: "/usr/" + rng.choice(("lib", "share", "local/lib")) + "/" + rng.choice(("x86_64-linux-gnu", "python3." + number(), word().lower())) + "/lib" + word().lower() + rng.choice((".so.", "-")) + number(),
        lambda: rng.choice(_CLASSES) * rng.randint(MIN_LENGTH, 60),
        lambda: (word().lower()[: rng.randint(2, 8)] * 8)[: rng.randint(MIN_LENGTH, 40)],
        lambda: word() + "=" + rng.choice((word().lower(), number(), path())) + rng.choice(("", "=" + word())),
        lambda: "".join(word().lower() for _ in range(rng.randint(3, 6))).capitalize(),
        lambda: rng.choice(("".join, "-".join))([word().upper() for _ in range(rng.randint(2, 5))]),
    )
    return [rng.choice(styles)() for _ in range(n)]


def random_strings(n: int, rng: random.Random) -> list[str]:
    """Strings as key generators write them: hexadecimal, base 32, 36, 62 and 64."""
    lower, upper, digits = _CLASSES[:26], _CLASSES[26:52], _CLASSES[52:62]
    alphabets = ("abcdef" + digits, upper + "234567", lower + digits, upper + digits, lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "_-")
    return ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(MIN_LENGTH, 48))) for _ in range(n)]


def labelled(text: str) -> tuple[set[str], set[str]]:
    """(words outside base spans, values of base spans) of a whole text."""
    words: set[str] = set()
    values: set[str] = set()
    spans, at = base_spans(text), 0
    for s, e, _ in [*spans, (len(text), len(text), 0)]:
        words.update(_WORD.findall(text[at:s]))
        at = max(at, e)
        value = text[s:e].rpartition("=")[2].strip(" \"'")
        if value.isascii() and len(value) >= MIN_LENGTH and not set(value) - set(_CLASSES):
            values.add(value)
    return words, values


def fit(texts: list[str], strings: int = SAMPLE_STRINGS, seed: int = 5) -> Model:
    """A model of whole texts at hand."""
    words: set[str] = set()
    values: set[str] = set()
    for text in texts:
        for known, own in zip((words, values), labelled(text), strict=True):
            known |= own
    return fit_labelled(list(words), list(values), strings, seed)


def fit_labelled(words: list[str], values: list[str], strings: int = SAMPLE_STRINGS, seed: int = 5) -> Model:
    """Every fifth word and secret is kept out of training. The thresholds lie above all but ``FALSE_ALARMS`` of the runs made of those words."""
    rng = random.Random(seed)
    words, values = sorted(set(words)), sorted(set(values))
    rng.shuffle(words)
    secret, cut = random_strings(strings, rng) + values, len(words) // 5
    rng.shuffle(secret)
    plain = ordinary_identifiers(words[cut:], 2 * strings, rng)
    ratio = _log_chances(secret[len(secret) // 5 :]) - _log_chances(plain)
    model = Model(ratio, 0.0)
    held = [t for t in (m.rstrip(".=-_/+") for m in ordinary_identifiers(words[:cut], strings, rng)) if len(t) >= MIN_LENGTH]
    if not held:
        model.threshold = model.stretch = MIN_RATIO
        return model
    whole = [max([model.score(t), *(model.score(m.group()) for m in _PART.finditer(t))]) for t in held]
    model.threshold = max(MIN_RATIO, float(np.quantile(whole, 1 - FALSE_ALARMS / 2)))
    model.stretch = max(model.threshold, float(np.quantile([model.best_stretch(t) for t in held], 1 - FALSE_ALARMS / 2)))
    return model


def _learnt(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for text in batch["t"]:
            words, values = labelled(text)
            kinds = np.repeat([False, True], [len(words), len(values)])
            yield pd.DataFrame({"secret": kinds, "value": pd.Series([*words, *values], dtype=object)})


def train(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fits on the words and base values of about ``sample_docs`` whole texts drawn by their hashes; at most ``SAMPLE_WORDS`` distinct words and as many values
    leave the executors."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("t"))
    rate = min(1.0, sample_docs / max(1, rows.count()))
    drawn = rows.filter(F.xxhash64("t").bitwiseAND(F.lit((1 << 62) - 1)) <= int(rate * (1 << 62)))
    found = drawn.mapInPandas(_learnt, "secret boolean, value string").distinct()
    place = F.row_number().over(Window.partitionBy("secret").orderBy(F.xxhash64("value"), "value"))
    picked = found.withColumn("_place", place).filter(F.col("_place") <= SAMPLE_WORDS).select("secret", "value").collect()
    return fit_labelled([r["value"] for r in picked if not r["secret"]], [r["value"] for r in picked if r["secret"]])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, model: Model, text: str = "text", passing: list[str] | None = None) -> DataFrame:
    """Adds n_assign, n_access, n_hex, n_random, base_sha256 and spans to the columns ``passing`` (all by default)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one float per transition of a fixed alphabet
    own = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
    keep = [c for c in (passing if passing is not None else docs.columns) if c not in own]

    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            rows = []
            for one in batch:
                spans = known.spans(one)
                kinds = [k for _, _, k in spans]
                base = _joined([s for s in spans if s[2] < 3])
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), _joined(spans)))
            yield pd.DataFrame(rows, columns=own)

    found = docs.select(*keep, find(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_found"))
    return found.select(*keep, *(f"_found.{c}" for c in own))

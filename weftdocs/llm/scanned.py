"""Problem 5: repair text of scanned pages.

1. `page` splits a text into lines and describes each by its position: how a line repeats near page
   boundaries, how numbers count up from page to page, what stands before and after it. Two averaged
   perceptrons read these page-position features: one tells scanned pages from other texts, the other
   tells furniture (running headers, footers, page numbers) from body lines. Both learn from pages laid
   out here from sound texts (`laid_out`), where it is known which lines were put in.
2. `counted` counts words and character windows of the whole corpus, exactly, in one aggregation. The
   table stays distributed; what a step needs of it is joined to it.
3. `confusions` joins the rare words and windows of scanned pages with frequent ones that differ in one
   place (one or two characters): substitutions that recur are the misreadings of this corpus.
4. `train` fits the averaged perceptron that edits characters. Its examples are sound lines of texts
   that were not scanned, with substitutions of the list put in at known places. It scores each edit
   that is possible at a place (replace, delete, insert) and each line join, against keep. Tasks train
   on their own shares, and their weights are averaged.
5. `repair` applies the editor to every scanned page, in blocks of bounded size: the counts that the
   edits of a block ask for are looked up by a join, and each block is edited with its own counts.

The training texts of both steps are a bounded sample (`TRAIN_TEXTS`); everything else covers all rows.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftdocs.session import cut, spread, table

SCANNED_KINDS = ("pdf", "image")
TRAIN_TEXTS = 400  # texts the perceptrons are fitted on
EPOCHS = 3
LAYOUTS = 8  # ways in which a training text is laid out as pages
FURNITURE = 2  # times that a furniture line counts in training
RATIO, FREQUENT = 30, 12  # a unit is rare beside another that is frequent and RATIO times as frequent
SUPPORT = 3  # different rare words that make a confusion
BLOCK_CHARS = 400_000  # characters of a block, for memory only
FLUSH = 2_000_000  # counts a task holds before it hands them on, for memory only

BREAK = re.compile(r"\r?\n")
MARK = re.compile(r"\[ページ ?\d+\]")
HYPHENS = "-‐‑­¬⁃–"
# Forms of a page number; the first group is its value.
NUMBER_FORMS = [
    re.compile(p, re.I)
    for p in (r"(\d{1,4})", r"(\d{1,4}) ?[/／] ?\d{1,4}", r"pp?\. ?(\d{1,4})", r"[—–―-] ?(\d{1,4}) ?[—–―-]", r"page (\d{1,4})(?: of \d{1,4})?", r"\[(\d{1,4})\]", r"\((\d{1,4})\)", r"ページ ?(\d{1,4})", r"第? ?(\d{1,4}) ?(?:頁|ページ)", r"([ivxl]{1,6})")
]
BARE = {0, 1, 9}  # forms that also stand in lists
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50}
LISTED = re.compile(r"(?:[-*・•o] |\d+[.)] |#+ |\d+/\d+ |[A-Z]\d+\()|\|")
CODE = re.compile(r"(?:^|\s{2,})[A-Z]{1,4}[-.]?\d{5,}$")  # the reference number of a document
ENDED = re.compile(r"[。．.!?！？」』)）:：][^。．.!?！？]{0,3}$")
WORD = re.compile(r"[A-Za-z0-9_!|$@§¡£€À-ɏ'’][A-Za-z0-9_!|$@§¡£€À-ɏ'’-]*")
IDEOGRAPH = re.compile("[぀-ヿ㐀-鿿]")


class Perceptron:
    """Averaged, with a margin."""

    def __init__(self):
        self.w: dict[str, float] = {}
        self.sum: dict[str, float] = {}
        self.t = 1

    def learn(self, f: list[str], y: int, margin: float = 1.0) -> None:
        self.t += 1
        if y * score(f, self.w) <= margin:
            for x in f:
                self.w[x] = self.w.get(x, 0.0) + y
                self.sum[x] = self.sum.get(x, 0.0) + y * self.t

    def fit(self, examples: list[tuple[list[str], int]], rng: random.Random, epochs: int = EPOCHS) -> Perceptron:
        for _ in range(epochs):
            rng.shuffle(examples)
            for f, y in examples:
                self.learn(f, y)
        return self

    def averaged(self) -> dict[str, float]:
        return {x: v - self.sum[x] / self.t for x, v in self.w.items() if v}


def score(f: list[str], w: dict[str, float]) -> float:
    return sum(w.get(x, 0.0) for x in f)


# ---------------------------------------------------------------- pages and furniture


def number_form(text: str) -> tuple[int, int] | None:
    """(form, value) of a line that is a page number and nothing else."""
    for k, p in enumerate(NUMBER_FORMS):
        m = p.fullmatch(text)
        if m:
            v = m[1].lower()
            if v.isdigit():
                return k, int(v)
            n = [ROMAN[c] for c in v]
            return k, sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0], strict=True))
    return None


def without_number(text: str) -> tuple[str, tuple[int, int] | None]:
    """A header or footer without the page number that stands apart from it."""
    parts = re.split(r"\s{2,}|\t", text.strip())
    if len(parts) > 1:
        for at in (-1, 0):
            form = number_form(parts[at])
            if form:
                rest = parts[:-1] if at == -1 else parts[1:]
                return "  ".join(rest), form
    return text.strip(), None


def shape(text: str) -> str:
    """A line for comparison."""
    t = unicodedata.normalize("NFKC", text).lower()
    return re.sub(r"\s+", " ", t).strip()


def near(a: str, b: str) -> bool:
    """Equal but for about one misread place."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 5:
        return False
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[n:][::-1], b[n:][::-1]
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return max(len(a), len(b)) - k <= 3


def repeats(shapes: list[tuple[int, str]]) -> list[list[int]]:
    """Lines of near shapes, as lists of line numbers. Near shapes share their first or their last characters."""
    groups: list[list[int]] = []
    first: list[str] = []
    by: dict[tuple, list[int]] = {}
    exact: dict[str, int] = {}
    for i, s in shapes:
        keys = [(side, k, part) for k in ((1,) if len(s) < 9 else (4,) if len(s) > 13 else (1, 4)) for side, part in ((0, s[:k]), (1, s[-k:]))]
        g = exact.get(s)
        if g is None:
            g = next((c for key in keys for c in by.get(key, ()) if near(first[c], s)), None)
        if g is None:
            g = len(groups)
            groups.append([])
            first.append(s)
            for key in keys:
                by.setdefault(key, []).append(g)
        exact[s] = g
        groups[g].append(i)
    return groups


@dataclass
class Page:
    """Lines of a text with what is known of each by its position."""

    lines: list[str]
    mark: list[bool]
    facts: dict[int, list[str]] = field(default_factory=dict)  # of lines that are neither blank nor marks
    whole: list[str] = field(default_factory=list)  # of the text
    running: list[bool] = field(default_factory=list)

    def body(self) -> list[int]:
        return [i for i, line in enumerate(self.lines) if line.strip() and not self.mark[i] and not self.running[i]]

    def settled(self, weights: dict[str, float]) -> Page:
        self.running = [i in self.facts and score(self.facts[i], weights) > 0 for i in range(len(self.lines))]
        return self


def tenth(share: float) -> int:
    return min(9, int(share * 10))


def page(text: str) -> Page:
    lines = BREAK.split(text)
    n = len(lines)
    bare = [x.strip() for x in lines]
    out = Page(lines, [bool(MARK.fullmatch(x)) for x in bare], running=[False] * n)
    mark = out.mark
    rest = [without_number(x) for x in lines]
    alone = [number_form(x) for x in bare]
    full = [i for i in range(n) if bare[i] and not mark[i]]
    width = sorted(len(bare[i]) for i in full)[int(len(full) * 0.9)] if full else 0
    # what hard-wrapped prose looks like: most lines are close to one width, and sentences go on after them
    prose = [i for i in full if i + 1 < n and len(lines[i].rstrip()) > 15 and "|" not in lines[i]]
    open_ended = [i for i in prose if not ENDED.search(bare[i]) and bare[i + 1]]
    widths = sorted(len(lines[i].rstrip()) for i in prose)
    wide = widths[int(len(widths) * 0.9)] if widths else 0
    even = sum(len(lines[i].rstrip()) >= 0.8 * wide for i in open_ended)
    broken = sum(bare[i][-1] in HYPHENS for i in full if len(bare[i]) > 15)
    layout = f"open{tenth(len(open_ended) / max(1, len(prose)))},even{tenth(even / max(1, len(open_ended)))}"
    wrapped = wide <= 120 and len(open_ended) >= 0.4 * len(prose) > 0 and even >= 0.6 * len(open_ended) > 0
    size = f"prose{min(8, len(prose)) if len(prose) < 4 else 4 + min(4, len(prose) // 8)}"
    out.whole = ["bias", layout, size, f"wide{min(12, wide // 15)}", f"wrapped{wrapped}", f"wrapped{wrapped},{size}", f"wide{min(12, wide // 15)},{layout}", f"broken{min(broken, 3)},{wrapped}", f"marks{any(mark)},{wrapped}"]

    def headerlike(i: int) -> bool:
        t = rest[i][0]
        if i + 1 < n and re.fullmatch(r"[^\W\d_]{1,8}", bare[i]) and (LISTED.match(bare[i + 1]) or alone[i + 1]):
            return False  # the label of a list
        return bool(t) and 3 <= len(t) <= (80 if rest[i][1] or CODE.search(t) else max(20, int(0.75 * width))) and not LISTED.match(t) and "|" not in t and not re.search(r"[。．.!?！？、,]$", t) and not alone[i]

    titles = {i for i in full if headerlike(i)}
    again: dict[int, tuple[int, int]] = {}  # line -> how many of its shape, and how far apart they lie
    for at in repeats([(i, shape(rest[i][0])) for i in full if i in titles]):
        for i in at:
            again[i] = (len(at), at[-1] - at[0])
    lettered = {i for i in titles if re.search(r"[^\W\d_]{2}", rest[i][0])}
    coded = {i for i in full if CODE.fullmatch(bare[i]) or (i in titles and CODE.search(rest[i][0]))}
    sure = [i in coded or (i in titles and rest[i][1] is not None) or (i in lettered and again[i][0] >= 2 and again[i][1] >= 4) for i in range(n)]

    def inside(i: int) -> bool:
        """In the middle of a paragraph."""
        return 0 < i < n - 1 and bool(bare[i - 1]) and bool(bare[i + 1]) and not ENDED.search(bare[i - 1]) and len(bare[i - 1]) > 0.6 * width

    def listed(i: int) -> bool:
        for j in (i - 1, i + 1):
            if 0 <= j < n and bare[j] and not mark[j] and not sure[j]:
                t = bare[j]
                if LISTED.match(t) and not re.match(r"\d+[.)] ", t) or (alone[j] and alone[j][0] in BARE) or (len(t) <= 12 and not ENDED.search(t) and not inside(j)):
                    return True
        return False

    of_page, p = [], 0
    for i in range(n):
        p += mark[i]
        of_page.append(p)
    nearest = {i: (k, len(full) - 1 - k) for k, i in enumerate(full)}
    before_of, after_of = [None] * n, [None] * n
    for order, into in ((range(n), before_of), (range(n - 1, -1, -1), after_of)):
        seen = None
        for i in order:
            into[i] = seen
            if bare[i]:
                seen = i
    numbers: dict[int, list[str]] = {}
    for k in range(len(NUMBER_FORMS)):
        last = None
        for i in full:
            if not alone[i] or alone[i][0] != k:
                continue
            v = alone[i][1]
            after = after_of[i]
            closes = (after is None or mark[after]) and any(mark) and v == of_page[i]  # the page's own number at its end
            goes_on = (v <= 3 if last is None else 0 < v - last <= 3) or (any(mark) and v == of_page[i])
            near_list = listed(i)
            word = "bare" if k in BARE else "dressed"
            numbers[i] = [f"number {word}", f"number {word},{closes},{goes_on},{near_list}", f"number {word},{closes},{goes_on}", f"number {word},{near_list}", f"number{k}"]
            if k not in BARE or closes or (goes_on and not near_list):
                last = v
                sure[i] = True
    for i in full:
        f = ["bias", f"wrapped{wrapped}", size + str(wrapped)]
        before, after = before_of[i], after_of[i]
        fed = lines[i].startswith("\f")
        top = before is None or mark[before] or fed
        end = after is None or mark[after] or lines[after].startswith("\f")
        follows = before is not None and sure[before] and (alone[before] is not None or rest[before][1] is not None)
        place = "feed" if fed else "top" if top else "follows" if follows else "end" if end else "mid"
        if i in numbers:
            f += [*numbers[i], "number", f"number,{place}", f"number,{wrapped}"]
        elif i in titles:
            count, far = again[i]
            opens = top or follows
            prior = before
            while prior is not None and (mark[prior] or sure[prior]):
                prior = before_of[prior]
            # the paragraph before the line is not over, and goes on behind it
            bridges = prior is not None and not ENDED.search(bare[prior]) and len(bare[prior]) > 0.6 * width and after is not None and not LISTED.match(bare[after])
            split = re.fullmatch(r"[^—–/／]{2,} [—–/／] [^—–/／]{2,}", bare[i]) is not None
            repeated = i in lettered and count >= 2 and far >= 4
            short = len(bare[i]) < 0.7 * width
            cuts, near_list = inside(i), listed(i)
            apart = rest[i][1] is not None
            kind = "code" if i in coded else "apart" if apart else "repeated" if repeated else "split" if split else "plain"
            solo = "repeated" if repeated else "single"
            f += ["title", f"title {kind}", f"title {kind},{wrapped}", f"{place},list{near_list},{wrapped}", f"opens{opens},list{near_list},{wrapped}", f"title {kind},{place},{wrapped}", f"title {kind},{place},short{short},list{near_list},{wrapped}", f"title {kind},bridges{bridges},opens{opens},cuts{cuts},short{short},list{near_list},{wrapped}"]
            f += [f"{solo},{place},bridges{bridges},list{near_list},{wrapped}", f"{solo},{place},short{short},{wrapped}", f"{solo},cuts{cuts},short{short},list{near_list},{wrapped}"]
            f += [f"repeated{min(count, 4)}"] if repeated else []
        elif i in coded:
            f += ["code alone", f"code alone,{wrapped}"]
        else:
            f += ["body", f"body,{place}", f"body ended{bool(ENDED.search(bare[i]))}", f"body listed{bool(LISTED.match(bare[i]))}"]
        out.facts[i] = f
    return out


# ---------------------------------------------------------------- learning what pages look like


def wrap(text: str, width: int, rng: random.Random) -> list[str]:
    """Prose in lines of about one width; words may be cut at a line end."""
    out, at, n = [], 0, len(text)
    wide = 3 * len(IDEOGRAPH.findall(text)) > n
    while n - at > width:
        end = at + width
        if not wide:
            blank = text.rfind(" ", at + 1, end + 1)
            if blank > at and rng.random() < 0.8:
                out.append(text[at:blank])
                at = blank + 1
                continue
            if text[end - 1].isalpha() and text[end].isalpha():
                out.append(text[at : end - 1] + rng.choice(HYPHENS))
                at = end - 1
                continue
        out.append(text[at:end])
        at = end
    return [*out, text[at:].strip()] if text[at:].strip() else out


def number_text(form: int, value: int, pages: int) -> str:
    roman = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"]
    forms = [f"{value}", f"{value}/{pages}", f"p. {value}", f"— {value} —", f"- {value} -", f"Page {value} of {pages}", f"page {value}", f"[{value}]", f"({value})", f"ページ {value}", f"{value} 頁", roman[value] if value < len(roman) else f"{value}"]
    return forms[form % len(forms)]


def laid_out(text: str, rng: random.Random) -> tuple[str, set[int]] | None:
    """A sound text laid out as scanned pages, and the numbers of the lines (from 0) that are furniture; None without prose."""
    parts = [x.strip() for x in BREAK.split(text) if x.strip()]
    prose = [x for x in parts if len(x) > 40 and "|" not in x]
    if not prose:
        return None
    words = re.findall(r"[^\W\d_]{3,12}", " ".join(prose))
    if not words:
        return None
    wide = 3 * len(IDEOGRAPH.findall("".join(prose))) > len("".join(prose))
    width = rng.randrange(24, 46) if wide else rng.randrange(46, 80)

    def title(k: int) -> str:
        t = ("" if wide else " ").join(rng.choice(words) for _ in range(k))
        return t if wide else t.title()

    body: list[str] = []
    for x in prose:
        body += wrap(x, width, rng)
        if rng.random() < 0.4:
            body.append("")
        if rng.random() < 0.12:  # a heading, or a list with its label
            body.append(f"{rng.randrange(1, 9)}. {title(2)}")
        if rng.random() < 0.2:
            items = [lambda: f"- {rng.randrange(1, 30)}. {title(1)}", lambda: str(rng.randrange(1, 99)), lambda: f"{rng.randrange(1, 12)}/{rng.randrange(1, 28)} {title(2)}"]
            body += ["", title(1)[:8]] + [rng.choice(items)() for _ in range(rng.randrange(1, 5))] + [""]
    high = max(3, len(body) // rng.randrange(1, 5))
    pages = [body[i : i + high] for i in range(0, len(body), high)]
    paged, headed, footed = rng.choice(["mark", "feed", "none", "none"]), rng.random(), rng.random()
    always = rng.choice([1.0, 0.5, 0.0, 0.0])  # how often a page has its header and footer
    name = rng.choice([lambda: f"{title(2)} {rng.randrange(1, 99)}", lambda: f"{title(2)} — {title(2)}", lambda: f"{title(1)} {rng.randrange(1, 99)} / {title(2)}", lambda: title(3)])()
    code = f"{rng.choice('ABDKMNR')}{rng.choice('ACELNRST')}-{rng.randrange(10**5, 10**9):09d}"
    form, numbered_head = rng.randrange(12), rng.random() < 0.3
    only = rng.randrange(1, len(pages) + 1) if always < 1 else 0  # a page that surely has its header
    lines: list[str] = []
    noise: set[int] = set()

    def put(line: str) -> None:
        noise.add(len(lines))
        lines.append(line)

    for k, part in enumerate(pages, 1):
        if paged == "mark":
            lines.append(f"[ページ{k}]")
        start = len(lines)
        number = number_text(form, k, len(pages))
        head = name if headed < 0.45 else f"{name}  {code}" if headed < 0.65 else None
        if head and (k == only or rng.random() < always):
            put(f"{head}   {number}" if numbered_head and rng.random() < 0.9 else head)
        lines += part
        foot = number if footed < 0.5 else f"{code}   {number}" if footed < 0.75 else code if footed < 0.8 else name if footed < 0.84 and headed >= 0.65 else None
        if foot and rng.random() < max(always, 0.8):
            if rng.random() < 0.3:
                lines.append("")
            put(foot)
        if paged == "feed" and k > 1 and len(lines) > start:
            lines[start] = "\f" + lines[start]
    return "\n".join(lines), noise


def sample_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_text): TRAIN_TEXTS texts at most, the same ones each time, in eight parts."""
    return df.filter(F.length(text) > 0).select(F.col(key).alias("_key"), F.col(text).alias("_text")).orderBy(F.xxhash64("_key"), "_text").limit(TRAIN_TEXTS).repartition(8, "_key").select("_text")


def summed(parts: DataFrame) -> dict[str, dict[str, float]]:
    """Weights of each model, over the tasks that trained it. As many as there are features of the bounded sample."""
    out: dict[str, dict[str, float]] = {}
    for r in parts.groupBy("model", "feature").agg(F.sum("weight").alias("weight")).collect():
        out.setdefault(r["model"], {})[r["feature"]] = r["weight"]
    return out


WEIGHTS = "model string, feature string, weight double"


def weights_of(models: dict[str, Perceptron]) -> pd.DataFrame:
    return pd.DataFrame([(m, x, v) for m, p in models.items() for x, v in sorted(p.averaged().items())], columns=["model", "feature", "weight"])


def train_layout(sample: DataFrame) -> dict[str, dict[str, float]]:
    """Weights of `page` (is it a scanned page) and `line` (is it furniture)."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wholes: list[tuple[list[str], int]] = []
        lines: list[tuple[list[str], int]] = []
        for batch in batches:
            for t in batch["_text"]:
                rng = random.Random(zlib.crc32(t.encode("utf-8", "replace")))
                plain = page(t)
                wholes += [(plain.whole, -1)] * LAYOUTS
                lines += [(f, -1) for f in plain.facts.values()]
                for _ in range(LAYOUTS):
                    made = laid_out(t, rng)
                    if made:
                        p = page(made[0])
                        wholes.append((p.whole, 1))
                        for i, f in p.facts.items():
                            lines += [(f, 1)] * FURNITURE if i in made[1] else [(f, -1)]
        if wholes:
            rng = random.Random(7)
            yield weights_of({"page": Perceptron().fit(wholes, rng), "line": Perceptron().fit(lines, rng)})

    return summed(sample.mapInPandas(fit, WEIGHTS))


# ---------------------------------------------------------------- counts over the corpus

MASK = (1 << 64) - 1
STEP, SMALL = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers: places of a window are kept apart
UNIT = "word string, context long, centre int"  # a word, or what stands around a CJK character and that character
WORD_CHAR = re.compile(r"[A-Za-z0-9_!|$@§¡£€À-ɏ'’]")
RUN = re.compile(WORD_CHAR.pattern + "+")


def folded(text: str) -> str:
    return re.sub(r"\d", "0", unicodedata.normalize("NFKC", text))


def plain_word(text: str) -> str:
    return folded(text).strip("-'’").lower()


def signed(h: int) -> int:
    h &= MASK
    return h - (1 << 64) if h >> 63 else h


def window(s: str) -> tuple[int, int] | None:
    """(context, centre) of a window of five or three characters."""
    s = folded(s)
    if len(s) == 5:
        a, b, d, e = ord(s[0]), ord(s[1]), ord(s[3]), ord(s[4])
        return signed(((a * STEP + b) * STEP + d) * STEP + e), ord(s[2])
    if len(s) == 3:
        return signed((ord(s[0]) * SMALL + ord(s[2])) * SMALL), ord(s[1])
    return None


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context of five, context of three, centre) of every CJK character; lines must be two line ends apart."""
    codes = np.frombuffer(("\n\n" + text + "\n\n").encode("utf-32-le", "replace"), "u4").astype("u8")
    at = np.flatnonzero(((codes >= 0x3040) & (codes <= 0x30FF)) | ((codes >= 0x3400) & (codes <= 0x9FFF)))
    a, b, c, d, e = (codes[at + k] for k in range(-2, 3))
    step, small = np.uint64(STEP), np.uint64(SMALL)
    with np.errstate(over="ignore"):
        return (((a * step + b) * step + d) * step + e).view("i8"), ((b * small + d) * small).view("i8"), c.astype("i4")


def grouped(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(how often, columns) of the distinct rows of long arrays."""
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return np.diff(np.append(first, len(order))), [c[first] for c in columns]


def counted(docs: DataFrame, text: str) -> DataFrame:
    """(word, context, centre, n): exact counts of words, and of windows of five and three, over all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def rows() -> Iterator[pd.DataFrame]:
            if words:
                yield pd.DataFrame({"word": list(words), "context": 0, "centre": 0, "n": list(words.values())})
            if parts:
                n, (centre, context) = grouped(parts)
                yield pd.DataFrame({"word": "", "context": context, "centre": centre, "n": n})
            words.clear(), parts.clear()

        for batch in batches:
            t = "\n\n\n".join(batch["_text"])
            t = folded(re.sub(r"\r?\n", "\n\n", t))
            words.update(w for w in (m.strip("-'’").lower() for m in WORD.findall(t)) if w)
            five, three, centre = windows_of(t)
            parts += [(centre, five), (centre, three)]
            held += 2 * len(centre)
            if held + len(words) > FLUSH:
                yield from rows()
                held = 0
        yield from rows()

    found = docs.select(F.col(text).alias("_text")).filter(F.length("_text") > 0).mapInPandas(count, f"{UNIT}, n long")
    return found.groupBy("word", "context", "centre").agg(F.sum("n").alias("n"))


class Counts:
    """The counts that a block asked for."""

    def __init__(self, rows: pd.DataFrame):
        words = rows["word"] != ""
        self.words = dict(zip(rows["word"][words], rows["n"][words].astype(int), strict=True))
        self.seen: dict[str, int] = {}  # windows looked up already
        self.edits: dict[str, list[tuple[int, int, str]]] = {}  # edits of words met already
        self.windows = dict(zip(zip(rows["context"][~words], rows["centre"][~words], strict=True), rows["n"][~words].astype(int), strict=True))

    def word(self, w: str) -> int:
        return self.words.get(w, 0)

    def window(self, s: str) -> int:
        n = self.seen.get(s)
        if n is None:
            n = self.seen[s] = self.windows.get(window(s), 0)
        return n


class Asked:
    """Stands for the counts of a block until they are known: notes what is asked for."""

    def __init__(self):
        self.words: set[str] = set()
        self.strings: set[str] = set()
        self.done: set[str] = set()  # words whose edits are noted

    def word(self, w: str) -> int:
        self.words.add(w)
        return 0

    def window(self, s: str) -> int:
        self.strings.add(s)
        return 0

    def rows(self, block: int) -> pd.DataFrame:
        keys = [k for k in {window(s) for s in self.strings} if k]
        words = [w for w in self.words if w]
        return pd.DataFrame({"block": block, "word": words + [""] * len(keys), "context": [0] * len(words) + [k[0] for k in keys], "centre": [0] * len(words) + [k[1] for k in keys]})


# ---------------------------------------------------------------- body text of a page


@dataclass
class Stream:
    """Body text of a page without line breaks; line and place of each character; joins of cut words."""

    text: str
    line: list[int]
    joins: list[tuple[int, int, str]]  # (line that ends in a hyphen, place in the text, the hyphen)


def streams(p: Page) -> list[Stream]:
    """One for each paragraph; furniture and page marks don't end a paragraph, other short lines do."""
    out: list[Stream] = []
    chars: list[str] = []
    at: list[int] = []
    joins: list[tuple[int, int, str]] = []

    def close() -> None:
        if chars:
            out.append(Stream("".join(chars), at[:], joins[:]))
        chars.clear(), at.clear(), joins.clear()

    body = "".join(p.lines[i] for i in p.body())
    cjk = 3 * len(IDEOGRAPH.findall(body)) > len(body)  # such text is cut anywhere
    widths = sorted(len(p.lines[i].strip()) for i in p.body())
    width = widths[int(0.9 * len(widths))] if widths else 0
    gap = short = False
    for i, line in enumerate(p.lines):
        t = line.strip()
        if p.mark[i] or p.running[i]:
            continue
        if not t:
            gap = True
            continue
        if chars and (short or LISTED.match(t) or (gap and (ENDED.search("".join(chars[-4:])) or not re.match(r"[a-zà-ÿ]|[぀-鿿]", t)))):
            close()
        gap, short = False, len(t) < 0.6 * width
        if chars:
            last = chars[-1]
            if last in HYPHENS and len(chars) > 1 and chars[-2].isalpha() and re.match(r"[A-Za-zÀ-ɏ]", t):
                joins.append((at[-1], len(chars) - 1, last))
            elif not (cjk or IDEOGRAPH.match(last) or IDEOGRAPH.match(t[0]) or last in "、。" or t[0] in "、。"):
                chars.append(" ")
                at.append(at[-1])
        chars += t
        at += [i] * len(t)
    close()
    return out


def laid(text: str, running: np.ndarray) -> Page:
    """A page whose furniture is known already: the numbers of its lines."""
    lines = BREAK.split(text)
    furniture = set(map(int, running))
    return Page(lines, [bool(MARK.fullmatch(x.strip())) for x in lines], running=[i in furniture for i in range(len(lines))])


# ---------------------------------------------------------------- the character editor


def level(n: int) -> int:
    return min(9, (max(n, 0) + 1).bit_length() - 1)


def gains(kind: str, levels: list[tuple[int, int]]) -> list[str]:
    out, gain = [], 0
    for k, (x, y) in enumerate(levels):
        gain += y - x
        out += [f"{kind}{k}now{x}", f"{kind}{k}new{y}", f"{kind}{k}both{x},{y}", f"{kind}{k}gain{y - x}"]
    return [*out, f"{kind}sum{gain}"]


def features(text: str, s: int, e: int, new: str, counts: Counts | Asked, own: int, own_after: int = 0) -> list[str]:
    """own: how often the units as they are now are counted by this very place; own_after: as they would be."""
    old = text[s:e]
    action = "replace" if len(old) == len(new) else "delete" if len(new) < len(old) else "insert"
    named = f"{old}>{new}" if len(old) < 3 else "several"
    if IDEOGRAPH.match(old) or IDEOGRAPH.match(new):
        left, right = ("\n\n" + text[max(0, s - 2) : s])[-2:], (text[e : e + 2] + "\n\n")[:2]
        now, after = left + old + right, left + new + right
        pairs = [(counts.window(x), counts.window(y)) for x, y in ((now, after), (now[1:-1], after[1:-1]))]
        return ["bias", "c" + action, named, *gains("c", [(level(x - own), level(y - own_after)) for x, y in pairs])]
    ws, we = s, e
    while ws > 0 and WORD_CHAR.match(text[ws - 1]):
        ws -= 1
    while we < len(text) and WORD_CHAR.match(text[we]):
        we += 1
    word = text[ws:we]
    x, y = counts.word(plain_word(word)), counts.word(plain_word(text[ws:s] + new + text[e:we]))
    shape_ = [f"len{min(len(word), 6)}", "upper" if word.isupper() else "mixed", "digits" if sum(c.isdigit() for c in word) > 1 else "few"]
    return ["bias", "l" + action, named, *gains("l", [(level(x - own), level(y - own_after))]), *shape_]


def edits_in(word: str, table_: dict[str, list[str]]) -> list[tuple[int, int, str]]:
    """Single edits (start, end, new) that the confusions allow within a word."""
    out = []
    for i in range(len(word)):
        for n in (1, 2):
            old = word[i : i + n].lower() if word[i].isascii() else word[i : i + n]
            if len(old) == n and len(word) > n and any(c.isalpha() for c in word[:i] + word[i + n :]):
                for new in table_.get(old, ()):
                    if not IDEOGRAPH.match(new):
                        out.append((i, i + n, new.upper() if word[i].isupper() and len(new) == 1 else new))
    return out


def word_edits(word: str, table_: dict[str, list[str]], counts: Counts | Asked) -> list[tuple[int, int, str]]:
    """Edits of a word that make a known word: single ones, or two of them as one edit. All of them while their counts are asked for."""
    asking = isinstance(counts, Asked)
    single = edits_in(word, table_)
    out = [(s, e, new) for s, e, new in single if counts.word(plain_word(word[:s] + new + word[e:])) or asking]
    if len(single) > 1 and len(word) > 5 and counts.word(plain_word(word)) < FREQUENT:
        for k, a in enumerate(single):
            for b in single[k + 1 :]:
                if b[0] >= a[1]:
                    new = word[: a[0]] + a[2] + word[a[1] : b[0]] + b[2] + word[b[1] :]
                    if counts.word(plain_word(new)) >= FREQUENT:
                        out.append((0, len(word), new))
    return out


def possible(text: str, table_: dict[str, list[str]], counts: Counts | Asked) -> Iterator[tuple[int, int, str]]:
    """Edits that the confusions allow, within words or CJK text."""
    for i, ch in enumerate(text):
        if ch in table_:
            for new in table_[ch]:
                if IDEOGRAPH.match(ch) or IDEOGRAPH.match(new):
                    yield i, i + 1, new
    asking = isinstance(counts, Asked)
    for m in RUN.finditer(text):
        word, at = m[0], m.start()
        if asking:
            if word in counts.done:
                continue
            counts.done.add(word)
            edits = word_edits(word, table_, counts)
        else:
            edits = counts.edits.get(word)
            if edits is None:
                edits = counts.edits[word] = word_edits(word, table_, counts)
        for s, e, new in edits:
            yield at + s, at + e, new


WORD_END, WORD_START = r"[^\W\d_]+(?=[^\W\d_]*$)[^\W\d_]*$", r"[^\W\d_]+"


def join_features(left: str, right: str, mark: str, counts: Counts | Asked) -> list[str]:
    """Features of joining a word cut at a line end; the other choice keeps the hyphen."""
    l, r = (re.search(WORD_END, left) or [""])[0].lower(), (re.match(WORD_START, right) or [""])[0].lower()
    joined, compound = level(counts.word(folded(l + r))), level(counts.word(folded(l + "-" + r)))
    first, second = level(counts.word(folded(l))), level(counts.word(folded(r)))
    return ["join", f"joined{joined}", f"compound{compound}", f"more{np.sign(joined - compound)}", f"jc{joined},{compound}", f"parts{min(first, 3)},{min(second, 3)}", "plain" if mark == "-" else "special"]


LATIN = "abcdefghijklmnopqrstuvwxyz0"
PAIRS_OF = ["fi", "fl", "ti", "li", "ri", "tt", "ll", "rn"]


def own_units(pages: DataFrame) -> DataFrame:
    """(word, context, centre, n): words as they stand and windows of five of the bodies of scanned pages."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = [s.text for t, r in zip(batch["_text"], batch["running"], strict=True) for s in streams(laid(t, r))]
            whole = "\n\n\n".join(bodies)
            words = Counter(w for w in (m.strip("-'’").lower() for m in WORD.findall(whole)) if len(w) >= 4 and "-" not in w and w.isascii() and any(c.isalpha() for c in w))
            if words:
                yield pd.DataFrame({"word": list(words), "context": 0, "centre": 0, "n": list(words.values())})
            five, _, centre = windows_of(folded(whole))
            if len(centre):
                n, (centre, five) = grouped([(centre, five)])
                yield pd.DataFrame({"word": "", "context": five, "centre": centre, "n": n})

    found = pages.mapInPandas(look, f"{UNIT}, n long")
    return found.groupBy("word", "context", "centre").agg(F.sum("n").alias("n"))


def holes(word: Column, size: int) -> Column:
    """(hole, part): the word with each place of `size` characters left open, and what stands there."""
    at = F.sequence(F.lit(1), F.length(word) - (size - 1))
    return F.transform(at, lambda i: F.struct(F.concat(F.substring(word, F.lit(1), i - 1), F.lit("\n"), F.substring(word, i + size, F.length(word))).alias("hole"), F.substring(word, i, F.lit(size)).alias("part"), i.alias("at")))


def confusions(pages: DataFrame, counts: DataFrame, support: int = SUPPORT) -> dict[str, list[str]]:
    """Misread characters -> what they stand for. As large as the alphabet at most."""
    own = cut(own_units(pages))
    often = counts.filter(F.col("n") >= FREQUENT)
    # words: rare ones of scanned pages and frequent ones of the corpus are equal but for one place
    mine = own.filter("word <> ''").select("word", F.regexp_replace("word", "[0-9]", "0").alias("plain"), F.col("n").alias("own"))
    known = counts.filter("word <> ''").select(F.col("word").alias("plain"), F.col("n").alias("now"))
    rare = mine.join(known, "plain")  # rare beside which of the frequent ones is told by the ratio of a pair
    frequent = often.filter("word <> '' AND length(word) >= 3").select(F.col("word").alias("other"), F.col("n").alias("most"))

    def opened(df: DataFrame, word: str, size: int) -> DataFrame:
        return df.withColumn("_h", F.explode(holes(F.col(word), size))).select("*", "_h.*").drop("_h")

    parts = []
    for old_size, new_size in ((1, 1), (2, 1), (1, 2)):
        left = opened(rare, "plain", old_size).withColumn("old", F.expr(f"substring(word, at, {old_size})")).select("hole", "old", F.col("plain").alias("unit"), F.col("now").alias("total"), F.col("own").alias("n"))
        right = opened(frequent, "other", new_size).select("hole", F.col("part").alias("new"), "most").filter(F.col("new").rlike("^[a-z0]$") if new_size == 1 else F.col("new").isin(PAIRS_OF))
        parts.append(left.join(right, "hole").filter((F.col("most") >= RATIO * F.col("total")) & (F.col("old") != F.col("new"))).select("old", "new", "unit", "total", "n"))
    # CJK characters: rare windows of scanned pages and frequent ones of the corpus with the same context
    seen = own.filter("word = ''").select("context", "centre", F.col("n").alias("own"))
    now = seen.join(counts.filter("word = ''").select("context", "centre", F.col("n").alias("now")), ["context", "centre"])
    other = often.filter("word = ''").select("context", F.col("centre").alias("other"), F.col("n").alias("most"))
    shown = now.join(other, "context").filter((F.col("other") != F.col("centre")) & (F.col("most") >= RATIO * F.col("now")))
    letter = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 4, "0")), "UTF-16BE")
    parts.append(shown.select(letter("centre").alias("old"), letter("other").alias("new"), F.col("context").cast("string").alias("unit"), F.col("now").alias("total"), F.col("own").alias("n")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("old", "new", "unit").agg(F.max("total").alias("total"), F.sum("n").alias("n"))
    # of CJK characters, one window is enough where it stands in several scanned paragraphs and nowhere else
    only_here = (F.col("n") >= support) & (F.col("total") <= 1.5 * F.col("n"))
    pairs = found.groupBy("old", "new").agg(F.count("*").alias("units"), F.max(only_here.cast("int")).alias("alone")).filter((F.col("units") >= support) | ((F.col("alone") == 1) & (F.col("old") >= "぀")))
    rows = pairs.orderBy(F.desc("units"), "old", "new").collect()
    units_of = {(r["old"], r["new"]): r["units"] for r in rows}
    out: dict[str, list[str]] = {}
    for (old, new), n in units_of.items():
        if len(old) != len(new) or n > 3 * units_of.get((new, old), 0):  # of two characters, one is misread
            out.setdefault(old, []).append(new)
    return out


def noised(text: str, back: list[tuple[str, str]], rng: random.Random) -> tuple[str, set[tuple[int, int, str]]]:
    """The text with up to three misreadings put in, and the edits that take them out again."""
    places = [(m.start(), m.end(), old) for old, new in back for m in re.finditer(re.escape(new), text)]
    rng.shuffle(places)
    chosen: list[tuple[int, int, str]] = []
    for s, e, old in places:
        if len(chosen) == rng.randrange(4):
            break
        if all(e + 1 < a or s > b + 1 for a, b, _ in chosen):
            chosen.append((s, e, old))
    out, at, edits = [], 0, set()
    size = 0
    for s, e, old in sorted(chosen):
        out += [text[at:s], old]
        size += s - at
        edits.add((size, size + len(old), text[s:e]))
        size += len(old)
        at = e
    return "".join([*out, text[at:]]), edits


def examples_of(text: str, table_: dict[str, list[str]], counts: Counts | Asked) -> Iterator[tuple[list[str], int]]:
    """Examples from one sound text. The misreadings put in depend on the text only, so that a second pass sees the same ones."""
    rng = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    back = [(old, new) for old, news in table_.items() for new in news]
    for piece in BREAK.split(text):
        if len(piece) < 12 or len(piece) > 400:
            continue  # a line of usual length is one example
        body, edits = noised(piece, back, rng)
        for s, e, new in possible(body, table_, counts):
            good = (s, e, new) in edits or (e - s > 2 and body[:s] + new + body[e:] in piece)
            near_ = any(abs(s - a) < 3 for a, _, _ in edits)
            if good or not near_ or isinstance(counts, Asked):
                yield features(body, s, e, new, counts, 0 if good else 1, 1 if good else 0), 1 if good else -1
        for m in re.finditer(r"[A-Za-zÀ-ɏ]{5,}", piece):
            k = rng.randrange(2, len(m[0]) - 1)
            yield join_features(m[0][:k], m[0][k:], rng.choice(HYPHENS), counts), 1
        for m in re.finditer(r"([A-Za-zÀ-ɏ]{2,})-([A-Za-zÀ-ɏ]{2,})", piece):
            f = join_features(m[1], m[2], "-", counts)
            yield f, -1
            yield f, -1


def blocks(df: DataFrame, schema: str, per_row) -> DataFrame:
    """Rows in blocks of about BLOCK_CHARS characters: per_row gives a row's tuple, or None to leave it out."""
    names = [c.split()[0] for c in schema.replace("`", "").split(", ")]

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                made = per_row(r)
                if made is not None:
                    rows.append((block, *made))
                    held += sum(len(x) for x in made if isinstance(x, str))
                    if held > BLOCK_CHARS:
                        block, held = block + 1, 0
            if rows:
                yield pd.DataFrame(rows, columns=["block", *names])

    return cut(df.mapInPandas(number, f"block long, {schema}"))


def looked_up(blocked: DataFrame, counts: DataFrame, note) -> DataFrame:
    """(block, word, context, centre, n): the counts that the rows of each block ask for, once per block."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, part in batch.groupby("block"):
                asked = Asked()
                for r in part.itertuples(index=False):
                    note(r, asked)
                rows = asked.rows(block)
                if len(rows):
                    yield rows

    return blocked.mapInPandas(ask, f"block long, {UNIT}").distinct().join(counts, ["word", "context", "centre"]).select("block", "word", "context", "centre", "n")


def train(sample: DataFrame, counts: DataFrame, table_: dict[str, list[str]]) -> dict[str, float]:
    """Weights of the editor."""
    blocked = blocks(sample, "_key int, _text string", lambda r: (0, r[-1]))
    shared = sample.sparkSession.sparkContext.broadcast(table_)

    def note(r, asked: Asked) -> None:
        for _ in examples_of(r[-1], shared.value, asked):
            pass

    def fit(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        known = Counts(found)
        examples = [x for t in texts["_text"] for x in examples_of(t, shared.value, known)]
        return weights_of({"edit": Perceptron().fit(examples, random.Random(7), 2)})

    found = looked_up(blocked, counts, note)
    return summed(blocked.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(fit, WEIGHTS)).get("edit", {})


def note_stream(s: Stream, table_: dict[str, list[str]], asked: Asked) -> None:
    """What the editor may ask about a stream, whether its cut words are joined or not."""
    joined = s.text
    for _, at, mark in reversed(s.joins):
        join_features(joined[:at].rstrip(), joined[at + 1 :], mark, asked)
        joined = joined[:at] + joined[at + 1 :]
    for text in {s.text, joined}:
        for a, e, new in possible(text, table_, asked):
            features(text, a, e, new, asked, 1)


def edited(s: Stream, weights: dict[str, float], table_: dict[str, list[str]], counts: Counts) -> tuple[str, set[int], set[int]]:
    """(repaired text, lines with a cut word, lines with a misread character)."""
    text, line = s.text, list(s.line)
    cut_lines: set[int] = set()
    for n, at, mark in reversed(s.joins):
        if score(join_features(text[:at].rstrip(), text[at + 1 :], mark, counts), weights) > 0:
            cut_lines.add(n)
            text = text[:at] + text[at + 1 :]
            del line[at]
    found = []
    for a, e, new in possible(text, table_, counts):
        value = score(features(text, a, e, new, counts, 1), weights)
        if value > 0:
            found.append((value, a, e, new))
    misread: set[int] = set()
    taken: list[tuple[int, int, str]] = []
    for _, a, e, new in sorted(found, key=lambda x: (-x[0], x[1])):
        if all(e <= b or a >= c for b, c, _ in taken):
            taken.append((a, e, new))
            same = [k for k in range(min(e - a, len(new))) if text[a + k] != new[k]] if e - a > 2 else [0]
            misread.update(line[a + k] for k in same[:1] + ([e - a - 1 - next((k for k in range(min(e - a, len(new))) if text[e - 1 - k] != new[len(new) - 1 - k]), 0)] if e - a > 2 else []))
    out = text
    for a, e, new in sorted(taken, reverse=True):
        out = out[:a] + new + out[e:]
    return out, cut_lines, misread


def repair(df: DataFrame, key: str, text: str, scanned: DataFrame) -> DataFrame:
    """(key, repaired, noise): for each scanned page its paragraphs, and (line_no, noise) of its lines.

    df is the whole corpus, from which words and characters are counted; scanned holds the rows to be
    repaired. Null and empty texts, and texts that are not laid out as pages, give no row. Repeated rows
    are repaired again. Without scanned texts there are no rows. Other columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()
    sound = cut(sample_of(df.join(scanned.select(key).distinct(), key, "left_anti"), key, text))
    layout = df.sparkSession.sparkContext.broadcast(train_layout(sound))

    def lay(r) -> tuple | None:
        p = page(r[1])
        if score(p.whole, layout.value.get("page", {})) <= 0:
            return None
        p.settled(layout.value["line"])
        return r[0], r[1], [i for i, x in enumerate(p.running) if x]

    pages = blocks(scanned.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.length("_text") > 0), f"_key {kind}, _text string, running array<int>", lay)
    counts = cut(counted(df, text))
    table_ = confusions(pages, counts)
    shared = df.sparkSession.sparkContext.broadcast((train(sound, counts, table_), table_))

    def note(r, asked: Asked) -> None:
        for s in streams(laid(r[2], r[3])):
            note_stream(s, shared.value[1], asked)

    def apply(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        (w, known), counts_ = shared.value, Counts(found)
        rows = []
        for k, t, r in zip(part["_key"], part["_text"], part["running"], strict=True):
            p = laid(t, r)
            noise = [(int(i) + 1, "running") for i in r]
            paragraphs = []
            for s in streams(p):
                body, cut_lines, misread = edited(s, w, known, counts_)
                paragraphs.append(body)
                noise += [(i + 1, "hyphen") for i in cut_lines] + [(i + 1, "misread") for i in misread]
            rows.append((k, "\n\n".join(paragraphs), [{"line_no": i, "noise": n} for i, n in sorted(set(noise))]))
        return pd.DataFrame(rows, columns=[key, "repaired", "noise"])

    found = looked_up(pages, counts, note)
    return pages.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(apply, f"`{key}` {kind}, repaired string, noise array<struct<line_no:int,noise:string>>")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "extracted_docs"))
    fixed = repair(docs, "ext_id", "text", docs.filter(F.col("kind").isin(*SCANNED_KINDS)))
    return fixed.select("ext_id", F.explode("noise").alias("n")).select("ext_id", "n.line_no", "n.noise").distinct()


def p5_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The scanned texts as continuous paragraphs."""
    docs = spread(table(spark, folder, "extracted_docs"))
    return repair(docs, "ext_id", "text", docs.filter(F.col("kind").isin(*SCANNED_KINDS))).select("ext_id", "repaired")

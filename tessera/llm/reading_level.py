"""Problem 8: the reading level of each document.

Method: a Rasch-style latent difficulty model. A document of level t uses item w (a word, or a trait of sentence building)
in proportion to ``p_w * exp(t * d_w - K(t))``: d_w is the item's difficulty, K makes the shares add up to one. Levels and
difficulties are estimated by distributed alternating optimisation: given the difficulties each document's level is the
maximum of its own concave likelihood; given the levels, each item's difficulty is the maximum of its own. Both need only
sums, so a round is one pass over the counted items and one small aggregation.

Rated documents tie the scale down: their (robust) rating is the mean of their prior, all others have prior mean 0.
Finally cuts between the levels are chosen on levels estimated *without* the ratings, so the cuts fit unrated documents.

Bounds: words are hashed to ITEMS slots, so difficulties are a vector of fixed size (broadcast, 1 MB) whatever the
vocabulary; levels live on a grid. All documents and all ratings count; nothing is sampled.

Only running prose counts: front matter, code, tables, headings, lists of values, dumps, quoted lines and longer quoted
passages are left out. ``levels`` has the documents whose prose is mainly English. ``document_levels`` has all documents: those
in Chinese characters, and those in German or with no English word, have a model of their own language; as nobody rated them,
their levels say where they stand among the documents of their language.

Words of one text are not independent, so n items count as n / (1 + n / CLUSTER) independent ones (the design effect of a
clustered sample): evidence grows with every item, ever more slowly.

Defined results: null and empty texts, and documents without prose, have no row in ``levels`` and a null level in
``document_levels``. Ratings that are null or not 1 to
5 are ignored, repeated ratings count once, raters without a name count as one rater; several ratings of a document enter
by their median. Repeated doc_ids give one row each (p8_found is distinct). Without any rating the scale starts from mean
word length and the cuts are equally spaced in standard deviations (-1.5, -0.5, 0.5, 1.5).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from tessera.llm.words import HAN
from tessera.session import cut

ITEMS = 1 << 18
TRAITS = 64  # the first slots: traits of sentence building
BLOCK = 1 << 12
GRID = np.linspace(-4, 4, 161)
ROUNDS, SETTLED = 4, 0.005  # rounds at most; mean change of the difficulties at which they end
CLUSTER = 400.0
PRIOR, RATED_PRIOR, ITEM_PRIOR = 4.0, 40.0, 8.0
TRAIT_WEIGHT = 3
CROWD = 0.5

#: Frequent words that tell English from German (fixed values).
ENGLISH = frozenset("the of and to a in is that it for with as on this by from at be are an or which not was have his her my our your its their each every one then but so if while than after before near under rather whose".split())
GERMAN = frozenset("der die das und ist nicht ein eine einen einem einer mit von für den dem des auf im zu zur zum wird werden auch sich bei nach oder wie über aus vor als an es sie er wir ihr".split())
HAN_CHAR = re.compile(f"[{HAN}]")
LATIN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
SENTENCE = re.compile(r"[.!?;]+(?=\s|$)|[。！？；]")
FENCE = re.compile(r"^\s*(```|~~~)")
SKIPPED = re.compile(r"^\s*(#{1,6}\s|\||>|!\[|<|\d{4}-\d\d-\d\d|[-*_=]{3,}\s*$|(def|class|import|from|return|log|for|if)\b.*[:(]\s*$)")
BULLET = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
PAIRS = re.compile(r"[\w-]+\s*[:=：]\s*\S+")
QUOTED = re.compile(r"“[^”\n]{25,}”|\"[^\"\n]{25,}\"|«[^»\n]{25,}»|「[^」\n]{12,}」")
CODE = re.compile(r"`[^`\n]*`|!?\[([^\]\n]*)\]\([^)\n]*\)|https?://\S+")


def prose(text: str) -> list[str]:
    """The lines of running prose."""
    lines, out, fence = text.split("\n"), [], ""
    start = 0
    if lines and lines[0].strip("\ufeff \t") == "---":
        stop = next((i for i in range(1, len(lines)) if lines[i].strip() in ("---", "...")), 0)
        start = stop + 1 if stop else 0
    for line in lines[start:]:
        if "`" in line or "~" in line:
            m = FENCE.match(line)
            if m:
                fence = "" if fence == m[1] else fence or m[1]
                continue
        if fence or not line.strip() or SKIPPED.match(line) or line.count("|") > 1 or line.startswith(("    ", "\t")) and not BULLET.match(line):
            continue
        line = BULLET.sub("", line)
        if "=" in line or ":" in line or "：" in line:
            held = len(PAIRS.findall(line))
            if held >= 2 and held * 4 >= len(line.split()):
                continue
        if '"' in line or "“" in line or "«" in line or "「" in line:
            line = QUOTED.sub(" ", line)
        if "`" in line or "](" in line or "://" in line:
            line = CODE.sub(lambda m: m[1] or " ", line)
        digits = sum(c.isdigit() for c in line)
        if digits * 3 > len(line):
            continue
        out.append(line)
    return out


_slots: dict[str, int] = {}


def slot(word: str) -> int:
    """The slot of a word."""
    at = _slots.get(word)
    if at is None:
        if len(_slots) > 1_000_000:
            _slots.clear()
        at = _slots[word] = TRAITS + xxh32_intdigest(word) % (ITEMS - TRAITS)
    return at


def items_of(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Slots and counts of the document's items; None without mainly English prose."""
    lang, items, counts = items_in(text)
    return (items, counts) if lang == "en" else None


EMPTY = np.empty(0, np.int32)


def items_in(text: str | None, others: bool = False) -> tuple[str | None, np.ndarray, np.ndarray]:
    """Language (en, zh, or xx for others), slots and counts of the document's items; no language without prose. Items of
    other languages than English are counted if asked for."""
    if not text:
        return None, EMPTY, EMPTY
    lines = prose(text)
    found, traits = [], Counter()
    for line in lines:
        for part in SENTENCE.split(line.lower()):
            own = LATIN.findall(part)
            if not own:
                continue
            found += own
            n = len(own)
            traits[min(n // 3, 15)] += TRAIT_WEIGHT
            traits[16 + min(sum(map(len, own)) * 2 // n, 31) % 32] += TRAIT_WEIGHT
            traits[48 + min(part.count(","), 7)] += TRAIT_WEIGHT
    if not found:
        return None, EMPTY, EMPTY
    whole = Counter(found)
    han = len(HAN_CHAR.findall("".join(lines)))
    english, german = sum(whole[w] for w in ENGLISH if w in whole), sum(whole[w] for w in GERMAN if w in whole)
    lang = "zh" if han > 1.6 * len(found) or (english == 0 and han > 0) else "xx" if german > english else "en"
    if lang != "en" and not others:
        return lang, EMPTY, EMPTY
    if lang == "zh":
        traits, whole = Counter(), Counter()
        for line in lines:
            for part in SENTENCE.split(line):
                own = "".join(HAN_CHAR.findall(part))
                if own:
                    traits[16 + min(len(own) // 3, 31)] += TRAIT_WEIGHT
                    traits[48 + min(part.count("，") + part.count("、"), 7)] += TRAIT_WEIGHT
                    whole.update(own[i : i + 2] for i in range(len(own) - 1))
    counts = Counter(traits)
    for w, n in whole.items():
        if len(w) > 1 and (lang == "zh" or not HAN_CHAR.search(w)):
            counts[slot(w)] += n
    if not counts:
        return None, EMPTY, EMPTY
    return lang, np.fromiter(counts.keys(), np.int32, len(counts)), np.fromiter(counts.values(), np.int32, len(counts))


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and rating: the median of a document's distinct valid ratings by rater."""
    valid = labels.where(F.col("level").between(1, 5) & F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("rater", F.lit("")).alias("rater"), "level").distinct()
    return valid.groupBy(F.col("doc_id").alias("rated_id")).agg(F.percentile("level", 0.5).alias("rating"))


def counted(spark: SparkSession, documents: DataFrame, labels: DataFrame, others: bool = False) -> DataFrame:
    """doc_id, items, counts (packed), rating of the English documents, or with ``others`` doc_id, lang, … of all documents;
    texts are read once and go no further."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [(k, *items_in(t, others)) for k, t in zip(frame["doc_id"], frame["text"], strict=True)]
            rows = [(k, lang, items.tobytes(), counts.tobytes()) for k, lang, items, counts in got if others or lang == "en"]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "items", "counts"])

    texts = documents.select("doc_id", "text")
    slim = (texts if others else texts.where("text IS NOT NULL AND text <> ''")).mapInPandas(run, f"doc_id {kind}, lang string, items binary, counts binary")
    slim = slim if others else slim.drop("lang")
    rated = ratings(labels)
    return cut(spark, slim.join(rated, slim["doc_id"] == rated["rated_id"], "left").drop("rated_id"), "reading")


class Model:
    """Difficulties, and K and its derivative on the grid of levels."""

    def __init__(self) -> None:
        self.difficulty = np.zeros(ITEMS)
        self.log_norm = np.zeros(len(GRID))
        self.slope = np.zeros(len(GRID))

    def levels(self, mean: np.ndarray, size: np.ndarray, center: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The level of each document: size * (mean - K'(t)) = weight * (t - center), by bisection on the grid."""
        pull = size[:, None] * (mean[:, None] - self.slope) - weight[:, None] * (GRID - center[:, None])
        at = np.clip((pull > 0).sum(1), 1, len(GRID) - 1)
        a, b = np.take_along_axis(pull, at[:, None] - 1, 1)[:, 0], np.take_along_axis(pull, at[:, None], 1)[:, 0]
        part = np.clip(np.divide(a, a - b, out=np.zeros_like(a), where=a != b), 0, 1)
        return GRID[at - 1] + part * (GRID[at] - GRID[at - 1])

    def fit_items(self, moment: np.ndarray, total: np.ndarray, weight: np.ndarray) -> None:
        """Given the sums over documents (count * level, count) per item and the items' weight per grid level."""
        base = np.log(np.maximum(weight, 1e-12)) - self.log_norm
        tilted = np.exp(base[None] + GRID[:, None] * GRID[None] - (base[None] + GRID[:, None] * GRID[None]).max(1, keepdims=True))
        expect = (tilted * GRID).sum(1) / tilted.sum(1)  # the mean level of an item of each difficulty
        seen = np.flatnonzero(total > 0)
        new = np.zeros(ITEMS)
        for own in np.array_split(seen, max(1, len(seen) // 20000)):
            pull = total[own, None] * (moment[own, None] / total[own, None] - expect) - ITEM_PRIOR * GRID
            at = np.clip((pull > 0).sum(1), 1, len(GRID) - 1)
            a, b = np.take_along_axis(pull, at[:, None] - 1, 1)[:, 0], np.take_along_axis(pull, at[:, None], 1)[:, 0]
            new[own] = GRID[at - 1] + np.clip(np.divide(a, a - b, out=np.zeros_like(a), where=a != b), 0, 1) * (GRID[1] - GRID[0])
        self.difficulty = new
        share = total / total.sum()
        scale = np.exp(np.clip(np.outer(GRID, GRID), -16, 16)) @ (weight / weight.sum() * np.exp(-self.log_norm))
        share = share / np.maximum(np.interp(new, GRID, scale), 1e-9)
        level = np.zeros(len(GRID))
        slope = np.zeros(len(GRID))
        for own in np.array_split(seen, max(1, len(seen) // 20000)):
            e = np.exp(np.outer(GRID, new[own])) * share[own]
            level += e.sum(1)
            slope += e @ new[own]
        self.log_norm, self.slope = np.log(np.maximum(level, 1e-300)), slope / np.maximum(level, 1e-300)


def _packed(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    items = [np.frombuffer(x, np.int32) for x in frame["items"]]
    sizes = np.array([len(x) for x in items])
    return np.concatenate(items), np.concatenate([np.frombuffer(x, np.int32) for x in frame["counts"]]).astype(float), np.cumsum(sizes) - sizes, sizes


def _estimate(model: Model, frame: pd.DataFrame, rated: bool) -> tuple[np.ndarray, tuple]:
    own = _packed(frame)
    items, counts, starts, _ = own
    size = np.add.reduceat(counts, starts)
    mean = np.add.reduceat(counts * model.difficulty[items], starts) / size
    rating = frame["rating"].to_numpy(float, na_value=np.nan)
    known = ~np.isnan(rating) & rated
    size = size / (1 + size / CLUSTER)
    return model.levels(mean, size, np.where(known, rating - 3, 0.0), np.where(known, RATED_PRIOR, PRIOR)), own


def fit(spark: SparkSession, table: DataFrame, rounds: int = ROUNDS) -> Model:
    """Alternate until the difficulties have settled, ``rounds`` times at most. Each round returns ITEMS / BLOCK packed rows and one histogram to the driver."""
    model, any_rated = Model(), table.where("rating IS NOT NULL").limit(1).count() > 0
    for n in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(frames: Iterator[pd.DataFrame], n=n, shared=shared) -> Iterator[pd.DataFrame]:
            moment, total, weight, some = np.zeros(ITEMS), np.zeros(ITEMS), np.zeros(len(GRID)), False
            for frame in frames:
                if not len(frame):
                    continue
                if n:
                    level, own = _estimate(shared.value, frame, True)
                    use = np.ones(len(frame), bool)
                else:  # the start: the ratings alone, or without any the mean word length
                    own = _packed(frame)
                    level = frame["rating"].to_numpy(float, na_value=np.nan) - 3
                    if not any_rated:
                        lengths = np.where((own[0] >= 16) & (own[0] < 48), own[0] - 16.0, 0) * own[1]
                        seen = ((own[0] >= 16) & (own[0] < 48)) * own[1]
                        level = np.add.reduceat(lengths, own[2]) / np.maximum(np.add.reduceat(seen, own[2]), 1) / 2 - 5
                    use = ~np.isnan(level)
                    level = np.where(use, level, 0.0)
                items, counts, starts, sizes = own
                counts = counts * np.repeat(use, sizes)
                moment += np.bincount(items, counts * np.repeat(level, sizes), ITEMS)
                total += np.bincount(items, counts, ITEMS)
                at = np.clip(np.rint((level - GRID[0]) / (GRID[1] - GRID[0])), 0, len(GRID) - 1).astype(int)
                weight += np.bincount(at, np.add.reduceat(counts, starts), len(GRID))
                some = True
            if some:
                rows = [(b, np.stack([moment[b * BLOCK : (b + 1) * BLOCK], total[b * BLOCK : (b + 1) * BLOCK]]).tobytes()) for b in range(ITEMS // BLOCK) if total[b * BLOCK : (b + 1) * BLOCK].any()]
                yield pd.DataFrame([*rows, (-1, weight.tobytes())], columns=["block", "sums"])

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            whole = None
            for x in frame["sums"]:
                own = np.frombuffer(x)
                whole = own.copy() if whole is None else whole + own
            return pd.DataFrame({"block": [frame["block"].iloc[0]], "sums": [whole.tobytes()]})

        # partial sums are added in two steps, so no task holds more than a share of the partitions'
        part = table.mapInPandas(run, "block int, sums binary").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(16)))
        part = part.groupBy("block", "salt").applyInPandas(lambda f: add(f.drop(columns="salt")), "block int, sums binary").groupBy("block").applyInPandas(add, "block int, sums binary")
        moment, total, weight = np.zeros(ITEMS), np.zeros(ITEMS), np.ones(len(GRID)) * 1e-9
        for block, sums in part.collect():
            own = np.frombuffer(sums)
            if block < 0:
                weight = weight + own
            else:
                moment[block * BLOCK : (block + 1) * BLOCK], total[block * BLOCK : (block + 1) * BLOCK] = own.reshape(2, -1)
        if total.sum() == 0:
            break
        before = model.difficulty
        model.fit_items(moment, total, weight)
        if n and np.abs(model.difficulty - before) @ total < SETTLED * total.sum():
            break
    return model


def score(spark: SparkSession, table: DataFrame, model: Model) -> DataFrame:
    """doc_id, theta (level without the document's own rating) and rating."""
    shared = spark.sparkContext.broadcast(model)
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"doc_id": frame["doc_id"], "theta": _estimate(shared.value, frame, False)[0], "rating": frame["rating"]})

    return table.mapInPandas(run, f"doc_id {kind}, theta double, rating double")


def cuts(scored: DataFrame) -> list[float]:
    """The four cuts between the levels: few errors on the rated documents, and few documents of the whole corpus close by
    (ratings are noisy; a cut through a crowd would split equals). Collected: a histogram on the grid."""
    step = (GRID[1] - GRID[0]) / 2
    above = [F.count_if(F.col("rating") >= k - 0.5).alias(f"above{k}") for k in (2, 3, 4, 5)]
    rows = scored.groupBy(F.rint((F.col("theta") - GRID[0]) / step).cast("int").alias("bin")).agg(*above, F.count("rating").alias("rated"), F.count(F.lit(1)).alias("n")).collect()
    size = 2 * len(GRID)
    n, rated = np.zeros(size), np.zeros(size)
    for r in rows:
        n[r["bin"]], rated[r["bin"]] = r["n"], r["rated"]
    if not rated.sum():
        return [-1.5, -0.5, 0.5, 1.5]
    crowd = np.convolve(n, np.ones(10), "full")[4 : 4 + size + 1] / n.sum()  # the share within five bins of each edge
    out: list[float] = []
    for k in (2, 3, 4, 5):
        high = np.zeros(size)
        for r in rows:
            high[r["bin"]] = r[f"above{k}"]
        low = rated - high
        errors = np.concatenate(([0], np.cumsum(high))) + np.concatenate((np.cumsum(low[::-1])[::-1], [0]))
        cost = errors / rated.sum() + CROWD * np.append(crowd, 0)[: size + 1]
        best = np.flatnonzero(cost <= cost.min() + 1e-9)
        best = best[np.abs(best - np.median(best)).argmin()]
        out.append(max(float(GRID[0] + (best - 0.5) * step), out[-1] if out else -9.0))
    return out


def levels(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, theta and level (1 easy to 5 scholarly) of every document with mainly English prose."""
    table = counted(spark, documents, labels)
    scored = score(spark, table, fit(spark, table))
    at = cuts(scored)
    level = F.lit(1) + sum(F.when(F.col("theta") >= c, 1).otherwise(0) for c in at)
    return scored.select("doc_id", F.round("theta", 4).alias("theta"), level.cast("int").alias("level"))


def document_levels(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, theta and level of every document (see the module's text)."""
    table = counted(spark, documents, labels, others=True)
    out = table.where("lang IS NULL").select("doc_id", "lang", F.lit(None).cast("double").alias("theta"), F.lit(None).cast("int").alias("level"))
    for lang in ("en", "zh", "xx"):
        own = table.where(F.col("lang") == lang).drop("lang")
        own = own if lang == "en" else own.withColumn("rating", F.lit(None).cast("double"))
        scored = score(spark, own, fit(spark, own))
        if lang == "en":
            at = cuts(scored)
        else:
            about = scored.agg(F.avg("theta").alias("m"), F.stddev_pop("theta").alias("s")).first()
            at = [(about["m"] or 0.0) + z * (about["s"] or 1.0) for z in (-1.5, -0.5, 0.5, 1.5)]
        level = F.lit(1) + sum(F.when(F.col("theta") >= c, 1).otherwise(0) for c in at)
        out = out.unionByName(scored.select("doc_id", F.lit(lang).alias("lang"), F.round("theta", 4).alias("theta"), level.cast("int").alias("level")))
    return out


def found(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """p8_found: the documents at level 4 or 5."""
    return levels(spark, documents, labels).where("level >= 4").select("doc_id").distinct()


def profile(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The corpus by source, language and level: documents and mean theta."""
    own = document_levels(spark, documents, labels)
    return own.join(documents.select("doc_id", "source").distinct(), "doc_id").groupBy("source", "lang", "level").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("theta"), 4).alias("theta"))

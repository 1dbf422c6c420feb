"""Statistics of document texts, and a rule list learned from labels that tells prose from lists, tables and junk."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents the rules are learned from, at most; drawn by a hash of the id.
MAX_LABELLED = 20_000
#: Thresholds tried for each statistic: its quantiles at so many places.
THRESHOLDS = 48
#: The text kinds that get rules, in this order; everything else is junk.
KINDS = ("prose", "table", "list")

# Frequent words of English, German, French, Spanish and Russian.
COMMON_WORDS = (
    "the a an of to and in is are was were be it that this which with for on by as at from not but or if when while "
    "der die das ein eine und in ist sind war von zu mit für auf nicht aber oder wenn dass als bei nach "
    "le la les un une des du de et en est sont pour dans sur pas mais ou si quand que qui par "
    "el los las una unos y es son por con para en no pero o si cuando que del al se "
    "и в не на что с по для как из это но или если когда без до перед после чтобы пока все они каждый каждую каждая"
).split()

_CJK = r"[぀-ヿ㐀-鿿]"
_WORD = r"\p{L}[\p{L}\p{M}'’-]*"
_BULLET = r"^\s*(?:[-*+•·‣◦–]\s|\[[ xX]?\]\s|\(?\d{1,4}[.):]\s|[a-zA-Z][.)]\s)"
_PAIR = r"^\s*[\p{L}_][^\s:=]{0,30}(?:\s[^\s:=]{1,20})?\s*[:=]\s*\S{1,30}(?:\s\S{1,20})?$"
_ITEM = r"^[\p{L}\p{N}_./()'’-]{1,40}(?:\s[\p{L}\p{N}_./()'’-]{1,30}){0,5}$"
# A line is closed if one of these is its last sign but for quotes and brackets.
_CLOSERS, _CLOSING_QUOTES = ".!?:;…。！？：；", "\"'”’)]"
_SPOKEN = rf"(?:^|\s)[(\"'“«¿¡]?{_WORD}[.,;:!?…)\"'”»]*(?=\s|$)"
_LISTED = r"(?:^|,\s)[^\s,.]{1,30}(?:\s[^\s,.]{1,20})?(?=,\s|$)"
_MOJIBAKE = r"[ÃÂÐÑâãäåæçèéÅ][\u0080-¿‘-›€™œŒšŠžŽ]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def text_statistics(documents: DataFrame) -> DataFrame:
    """One row of statistics per document, all by native expressions.

    doc_id, then: chars, words, mean_word_length, longest_word, symbol_ratio,
    digit_ratio, letter_ratio, common_word_share, distinct_word_share, line_count,
    mean_line_length, closed_line_share (lines ending in punctuation),
    bullet_line_share, pair_line_share, short_line_share, item_share (lines that are
    short items, or the comma-separated items of one line), cell_line_share (lines
    with the document's usual number of cells, two at least), comma_item_share,
    broken_share (wrongly decoded characters), sentence_share (share of the
    characters in lines that read as sentences: most
    tokens are words, and frequent words of a known language are among them). A null text counts as empty:
    its statistics are 0. In Chinese and Japanese a character counts as a word
    for the shares of common and distinct words only.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = documents.select("doc_id", F.regexp_replace(text, "\r\n?", "\n").alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda l: F.length(F.trim(l)) > 0)
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"({_WORD})"), 1)
    base = base.withColumn("lines", lines).withColumn("word_list", words)

    def sign(line: Column, mark: str) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))

    def tight(line: Column, mark: str) -> Column:
        """How often the mark stands before something else than a space."""
        return F.when(F.contains(line, F.lit(mark)), _count(line, rf"{mark}(?=\S)")).otherwise(0)

    def cells(line: Column) -> Column:
        piped = sign(line, "|")
        return F.greatest(
            F.when(piped >= 3, piped - 1).otherwise(0), sign(line, "\t") + 1,
            F.when(F.contains(line, F.lit("  ")), _count(line, r"\S {2,}\S") + 1).otherwise(1), tight(line, ";") + 1, tight(line, ",") + 1,
        )

    # Each step looks at what the step before it has found of a line, so nothing is looked for twice,
    # and the dear patterns only where the cheap ones leave it open.
    def closed(line: Column) -> Column:
        last = F.right(F.rtrim(F.rtrim(line, F.lit(" \t\n\x0b\f\r")), F.lit(_CLOSING_QUOTES)), F.lit(1))
        return (last != "") & F.contains(F.lit(_CLOSERS), last)

    ascii_only = lambda l: F.octet_length(l) == F.length(l)
    seen = F.transform("lines", lambda l: F.struct(
        l.alias("line"), F.length(l).alias("n"), F.size(F.split(F.trim(l), r"\s+")).alias("tokens"), l.rlike(_BULLET).alias("bullet"), closed(l).alias("closed"),
        F.when(ascii_only(l), 0).otherwise(_count(l, _CJK)).alias("cjk")))
    seen = F.transform(seen, lambda s: F.struct(
        s["line"].alias("line"), s["n"].alias("n"), s["tokens"].alias("tokens"), s["bullet"].alias("bullet"), s["closed"].alias("closed"), s["cjk"].alias("cjk"),
        (~s["bullet"] & (F.contains(s["line"], F.lit(":")) | F.contains(s["line"], F.lit("="))) & s["line"].rlike(_PAIR)).alias("other_pair"),
        F.when(s["bullet"] | (s["tokens"] < 5), 0).otherwise(_count(s["line"], _SPOKEN)).alias("spoken")))

    def sentence(s: Column) -> Column:
        common = F.size(F.filter(F.split(F.lower(s["line"]), r"[^\p{L}\p{M}]+"), lambda w: w.isin(COMMON_WORDS)))
        latin = (s["spoken"] >= 5) & (s["spoken"] >= 0.6 * s["tokens"]) & (s["closed"] | (s["spoken"] >= 7)) & (
            common >= F.greatest(F.lit(1), F.ceil(s["spoken"] / 15)))
        return ~s["bullet"] & (latin | ((s["cjk"] >= 9) & (s["cjk"] >= 0.5 * F.length(F.regexp_replace(s["line"], r"\s", "")))))

    seen = F.transform(seen, lambda s: F.struct(
        s["n"].alias("n"), cells(s["line"]).alias("cells"), sentence(s).alias("sentence"), s["bullet"].alias("bullet"),
        (s["other_pair"] | (s["bullet"] & s["line"].rlike(_PAIR))).alias("pair"), s["closed"].alias("closed"), (s["tokens"] <= 6).alias("short"),
        (s["bullet"] | s["other_pair"] | ((s["tokens"] <= 6) & F.trim(s["line"]).rlike(_ITEM))).alias("item"),
    ))
    base = base.withColumn("seen", seen)

    def share(flag: str) -> Column:
        return _ratio(F.size(F.filter("seen", lambda s: s[flag])), F.size("seen"))

    def weight(condition) -> Column:
        return F.aggregate(F.filter("seen", condition), F.lit(0), lambda acc, s: acc + s["n"])

    wide = F.array_sort(F.transform(F.filter("seen", lambda s: s["cells"] >= 2), lambda s: s["cells"]))
    usual = F.when(F.size(wide) > 0, F.element_at(wide, (F.size(wide) / 2).cast("int") + 1)).otherwise(F.lit(0))
    rest = lambda kept: F.length(F.regexp_replace("text", kept, ""))
    base = (
        base.withColumn("usual", usual).withColumn("dense", rest(r"\s+")).withColumn("letters", rest(r"[^\p{L}\p{M}]+"))
        .withColumn("digits", rest(r"\P{N}+")).withColumn("cjk", F.when(ascii_only(F.col("text")), 0).otherwise(_count(F.col("text"), _CJK)))
        .withColumn("common", F.size(F.filter("word_list", lambda w: w.isin(COMMON_WORDS))))
        .withColumn("total", F.aggregate("seen", F.lit(0), lambda acc, s: acc + s["n"]))
        .withColumn("commas", sign(F.col("text"), ",")).withColumn("items", F.when(F.col("commas") == 0, F.least(_count(F.col("text"), _LISTED), F.lit(1))).otherwise(_count(F.col("text"), _LISTED)))
    )
    chars, size, dense, cjk, total = F.length("text"), F.size("word_list"), F.col("dense"), F.col("cjk"), F.col("total")
    inline = F.when(F.size("seen") <= 2, _ratio(F.col("items"), F.col("commas") + 1)).otherwise(F.lit(0.0))
    return base.select(
        "doc_id",
        chars.alias("chars"),
        size.alias("words"),
        _ratio(F.aggregate("word_list", F.lit(0), lambda acc, w: acc + F.length(w)), size).alias("mean_word_length"),
        F.coalesce(F.array_max(F.transform(F.split("text", r"\s+"), lambda w: F.length(w))), F.lit(0)).alias("longest_word"),
        _ratio(dense - F.col("letters") - F.col("digits"), dense).alias("symbol_ratio"),
        _ratio(F.col("digits"), dense).alias("digit_ratio"),
        _ratio(F.col("letters"), dense).alias("letter_ratio"),
        _ratio(F.col("common") + cjk, size + cjk).alias("common_word_share"),
        _ratio(F.size(F.array_distinct("word_list")) + cjk, size + cjk).alias("distinct_word_share"),
        F.size("seen").alias("line_count"),
        _ratio(total, F.size("seen")).alias("mean_line_length"),
        share("closed").alias("closed_line_share"),
        share("bullet").alias("bullet_line_share"),
        share("pair").alias("pair_line_share"),
        share("short").alias("short_line_share"),
        F.greatest(share("item"), inline).alias("item_share"),
        _ratio(F.size(F.filter("seen", lambda s: (s["cells"] >= 2) & (s["cells"] == F.col("usual")))), F.size("seen")).alias("cell_line_share"),
        _ratio(F.col("items"), F.col("commas") + 1).alias("comma_item_share"),
        _ratio(F.when(ascii_only(F.col("text")), 0).otherwise(_count(F.col("text"), _MOJIBAKE)) * 2, chars).alias("broken_share"),
        _ratio(weight(lambda s: s["sentence"]), total).alias("sentence_share"),
    )


STATISTICS = (
    "sentence_share", "cell_line_share", "item_share", "mean_word_length", "longest_word", "symbol_ratio", "digit_ratio", "letter_ratio", "common_word_share",
    "distinct_word_share", "line_count", "mean_line_length", "closed_line_share", "bullet_line_share", "pair_line_share",
    "short_line_share", "comma_item_share", "broken_share", "chars",
)


def agreed_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) where one label has more votes than any other; nulls don't vote, repeats vote once."""
    votes = (
        labels.where("doc_id is not null and label is not null").select("doc_id", "annotator", "label").distinct()
        .groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    )
    rank = Window.partitionBy("doc_id")
    best = votes.withColumn("top", F.max("votes").over(rank)).where("votes = top")
    return best.groupBy("doc_id").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("n")).where("n = 1").select("doc_id", "label")


def _grow_rule(x: np.ndarray, y: np.ndarray, edges: list[np.ndarray]) -> list[tuple[int, str, float]]:
    """Adds the condition of the greatest information gain until no negatives are covered."""
    rule: list[tuple[int, str, float]] = []
    covered = np.ones(len(y), dtype=bool)
    while True:
        p, n = int((y & covered).sum()), int((~y & covered).sum())
        if p == 0 or n == 0:
            break
        before, best, gain = np.log2(p / (p + n)), None, 1e-9
        for f, cuts in enumerate(edges):
            v = x[:, f]
            for cut in cuts:
                for sign, hit in ((">=", v >= cut), ("<", v < cut)):
                    kept = hit & covered
                    q = int((y & kept).sum())
                    if q == 0:
                        continue
                    m = int(kept.sum()) - q
                    g = q * (np.log2(q / (q + m)) - before)
                    if g > gain:
                        best, gain = (f, sign, float(cut)), g
        if best is None:
            break
        rule.append(best)
        covered &= _matches([best], x)
    return rule


def _matches(rule: list[tuple[int, str, float]], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for f, sign, cut in rule:
        hit &= (x[:, f] >= cut) if sign == ">=" else (x[:, f] < cut)
    return hit


def _pays(rule: list[tuple[int, str, float]], covered: np.ndarray, positive: np.ndarray, left: np.ndarray, choices: int) -> bool:
    """Whether the rule is shorter than the exceptions it saves, in bits.

    A condition costs the choice of one of all thresholds and of its sign, half
    of it as conditions come in any order; an exception costs the choice of a row.
    """
    rows = int(left.sum())
    right, wrong = int((covered & positive).sum()), int((covered & ~positive).sum())
    return 0.5 * len(rule) * np.log2(2 * max(2, choices)) < (right - wrong) * np.log2(max(2, rows))


def learn_rules(x: np.ndarray, labels: np.ndarray, kinds=KINDS, seed: int = 7) -> list[tuple[str, list[tuple[int, str, float]]]]:
    """An ordered rule list by incremental reduced-error pruning.

    For each kind in turn, rules grow on two thirds of the remaining rows and
    lose final conditions as long as that helps on the last third; a rule that
    is wrong on half of the rows it covers there ends the kind, and so does one
    that costs more to write down than the exceptions it saves (``_pays``).
    Rows a rule covers leave the data before the next one grows. Nothing else
    bounds the number of rules or conditions.
    """
    rng = np.random.default_rng(seed)
    left = np.ones(len(labels), dtype=bool)
    rules: list[tuple[str, list[tuple[int, str, float]]]] = []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, THRESHOLDS))) if len(x) else np.array([]) for f in range(x.shape[1])]
    # midpoints between neighbouring quantiles generalise better than the values themselves
    edges = [(e[1:] + e[:-1]) / 2 for e in edges]
    for kind in kinds:
        while True:
            rows = np.nonzero(left)[0]
            y = labels[rows] == kind
            if y.sum() < 3:
                break
            part = rng.random(len(rows)) < 2 / 3
            grow, prune = rows[part], rows[~part]
            rule = _grow_rule(x[grow], labels[grow] == kind, edges)
            if not rule:
                break

            def worth(r):
                hit = _matches(r, x[prune])
                good = int((hit & (labels[prune] == kind)).sum())
                return (2 * good - int(hit.sum())) / max(1, int(hit.sum())), good

            best = max(((worth(rule[:k])[0], -k) for k in range(1, len(rule) + 1)))
            rule = rule[: -best[1]]
            value, good = worth(rule)
            covered = _matches(rule, x) & left
            if value <= 0 or good == 0 or not _pays(rule, covered, labels == kind, left, sum(map(len, edges))):
                break
            rules.append((kind, rule))
            left &= ~_matches(rule, x)
    return rules


def rules_case(rules, statistics=STATISTICS) -> str:
    """The rule list as one SQL CASE expression."""
    if not rules:
        return "'junk'"
    arms = [
        f"WHEN {' AND '.join(f'{statistics[f]} {sign} {cut!r}D' for f, sign, cut in rule)} THEN '{kind}'" for kind, rule in rules
    ]
    return f"CASE {' '.join(arms)} ELSE 'junk' END"


def fit_text_kinds(statistics: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> str:
    """Learns the CASE expression from at most ``most`` labelled documents (by hash of doc_id).

    No labels at all give ``'junk'`` for every document.
    """
    sample = (
        statistics.join(agreed_labels(labels), "doc_id").select("doc_id", "label", *STATISTICS)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toPandas()
    )
    if sample.empty:
        return rules_case([])
    return rules_case(learn_rules(sample[list(STATISTICS)].to_numpy(dtype=float), sample["label"].to_numpy(dtype=object)))


def used_statistics(case: str) -> list[str]:
    """The statistics that ``text_kinds`` reads for a CASE expression."""
    named = set(re.findall(r"[a-z_]+", case))
    return [c for c in STATISTICS if c in named or c in ("letter_ratio", "digit_ratio")]


def text_kinds(statistics: DataFrame, case: str) -> DataFrame:
    """Statistics with ``text_kind``; texts without a letter or digit are junk whatever the rules say."""
    return statistics.withColumn("text_kind", F.when((F.col("letter_ratio") + F.col("digit_ratio")) == 0, "junk").otherwise(F.expr(case)))

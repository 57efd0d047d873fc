"""Weighted text rules from a table of any usual size: thousands of patterns instead of forty columns.

Testing every pattern on every text costs a regular expression a rule. Here each rule is filed under the
longest literal word it cannot match without. One Aho-Corasick automaton over those words reads a text
once, whatever the number of rules, and names the rules whose word occurs; only their patterns are run, in
the JVM with the same syntax and flags as generated rule columns, so results are the same. Rules without
such a word are run on every text. The automaton is built once a task and sees texts in Arrow batches;
what it returns is a short list of rule numbers, and the text itself never comes back from Python.

The catalogue is collected and travels with the plan, so its size is checked against ``MOST_RULES``.

``rule_signals`` takes a rule table of any size, which stays a table. Only beginnings of the rules' words
are collected, as long as they can be with at most ``MOST_HEADS`` different ones; their automaton finds where a
word may begin. What stands there, at the lengths of the words, is joined with the words themselves, and the
rules found are verified by their pattern as above.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fence import settle
from ..functions.text import as_literal, round_half_even
from ..session import written
from .lookup import lookup_join
from .rules import Catalogue, needles, rule_confidence

MOST_RULES = 100_000
#: Different beginnings of words that are collected for the automaton of a rule table.
MOST_HEADS = 50_000


def load_catalogue(rules: DataFrame, most: int = MOST_RULES) -> Catalogue:
    """Rows ``(document_type, pattern, base, ord)`` as a catalogue: types by their first rule, rules by ``ord``.

    A type's base is that of its first rule. More than ``most`` rules are an error, not cut off.
    """
    rows = rules.select("document_type", "pattern", "base", "ord").where(
        "document_type IS NOT NULL AND pattern IS NOT NULL").orderBy("ord", "document_type", "pattern").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    types: dict[str, tuple[list[str], float]] = {}
    for r in rows:
        types.setdefault(r["document_type"], ([], float(r["base"] or 0.0)))[0].append(r["pattern"])
    return [(t, patterns, base) for t, (patterns, base) in types.items()]


def rule_finder(catalogue: Catalogue):
    """Column function: numbers, ascending, of the rules whose literal word occurs in a lower-cased text."""
    words: dict[str, list[int]] = {}
    always: list[int] = []
    number = 0
    for _, patterns, _ in catalogue:
        for pattern in patterns:
            found = needles(pattern)
            words.setdefault(max(found, key=len), []).append(number) if found else always.append(number)
            number += 1

    # Everything the task needs is a local name, so workers need not have this package.
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick
        import pandas

        automaton = ahocorasick.Automaton()
        for word, numbers in words.items():
            automaton.add_word(word, numbers)
        if words:
            automaton.make_automaton()

        def one(text: str | None) -> list[int]:
            if text is None:
                return []
            hits = {id(numbers): numbers for _, numbers in automaton.iter(text)} if words else {}
            return sorted({n for numbers in hits.values() for n in numbers}.union(always))

        for texts in batches:
            yield pandas.Series([one(t) for t in texts], dtype=object)

    return F.pandas_udf(find, "array<int>")


def rank_found(lowered: Column, candidates: Column, catalogue: Catalogue) -> Column:
    """Signals by falling confidence, ties in catalogue order, from the candidates whose pattern matches."""
    patterns = as_literal([p for _, ps, _ in catalogue for p in ps], "array<string>")
    owner = as_literal([i for i, (_, ps, _) in enumerate(catalogue) for _ in ps], "array<int>")
    names = as_literal([t for t, _, _ in catalogue], "array<string>")
    levels = as_literal([[rule_confidence(base, h, len(ps)) for h in range(1, len(ps) + 1)] for _, ps, base in catalogue],
                        "array<array<double>>")
    matched = F.filter(candidates, lambda n: F.rlike(lowered, F.concat(F.lit("(?idU)"), F.get(patterns, n))))
    # A row's matches as one map: type number to (hits, first rule); matches come in catalogue order.
    pairs = F.transform(matched, lambda n: F.struct(F.get(owner, n).alias("type"), n.alias("rule")))

    def signal(kind: Column, hits: Column, first: Column) -> Column:
        score = F.get(F.get(levels, kind), hits - 1)
        return F.struct((-score).alias("neg"), kind.alias("ord"), F.get(names, kind).alias("document_type"),
                        score.alias("confidence"), F.get(patterns, first).alias("matched_rule"))

    folded = F.aggregate(
        pairs, F.array().cast("array<struct<type:int,hits:int,rule:int>>"),
        lambda done, p: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["type"] == p["type"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(
                p["type"].alias("type"), (F.try_element_at(done, F.lit(-1))["hits"] + 1).alias("hits"),
                F.try_element_at(done, F.lit(-1))["rule"].alias("rule")))),
        ).otherwise(F.concat(done, F.array(F.struct(p["type"].alias("type"), F.lit(1).alias("hits"), p["rule"].alias("rule"))))))
    return F.sort_array(F.transform(folded, lambda g: signal(g["type"], g["hits"], g["rule"])))


def apply_rule_table(df: DataFrame, catalogue: Catalogue, text: str = "full_text") -> DataFrame:
    """Add ``signals``, as generated rule columns would for the same catalogue; narrow, no shuffle."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_lowered", lowered)
    df = df.withColumn("_rules", rule_finder(catalogue)(F.col("_lowered")))
    return settle(df.withColumn("signals", rank_found(F.col("_lowered"), F.col("_rules"), catalogue)).drop("_lowered", "_rules"))


def literal_word(pattern: Column) -> Column:
    """The longest of a pattern's ``needles``, '' if it has none."""
    parts = F.split(F.replace(pattern, F.lit("\\b"), F.lit("")), r"\\d\+|\.\*")
    odd = F.exists(parts, lambda p: F.rlike(p, F.lit(r"[\\\[\](){}|?*+.^$]")))
    words = F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), F.lower(p).alias("word")))
    return F.when(odd, F.lit("")).otherwise(F.array_max(words)["word"])


def word_heads(words: DataFrame, most: int = MOST_HEADS) -> list[tuple[str, list[int]]]:
    """Beginnings of all words in column ``word``, each with the lengths of its words.

    They are as long as they can be with at most ``most`` of them, so a text meets few that begin no word.
    One character is the shortest, whatever their number.
    """
    sizes = F.length("word")
    longest = words.agg(F.max(sizes)).first()[0] or 0
    low, high = 1, max(1, longest)
    while low < high:
        middle = (low + high + 1) // 2
        few = words.select(F.left("word", F.lit(middle)).alias("head")).distinct().limit(most + 1).count() <= most
        low, high = (middle, high) if few else (low, middle - 1)
    heads = words.groupBy(F.left("word", F.lit(low)).alias("head")).agg(F.collect_set(sizes).alias("sizes"))
    return [(r["head"], sorted(r["sizes"])) for r in heads.collect()]


def word_finder(heads: list[tuple[str, list[int]]]):
    """Column function: the different pieces of a lower-cased text that may be words with one of the heads."""
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick
        import pandas

        automaton = ahocorasick.Automaton()
        for head, sizes in heads:
            automaton.add_word(head, (len(head), sizes))
        if heads:
            automaton.make_automaton()

        def one(text: str | None) -> list[str]:
            found = set()
            for end, (size, sizes) in automaton.iter(text) if heads and text else ():
                start = end - size + 1
                found.update(text[start:start + n] for n in sizes if start + n <= len(text))
            return list(found)

        for texts in batches:
            yield pandas.Series([one(t) for t in texts], dtype=object)

    return F.pandas_udf(find, "array<string>")


def rule_signals(docs: DataFrame, rules: DataFrame, key: str, text: str = "full_text", most_heads: int = MOST_HEADS) -> DataFrame:
    """``apply_rule_table`` for rules ``(document_type, pattern, base, ord)`` in a table of any size: a row a signal.

    Returns ``key``, ``document_type``, ``confidence`` and ``matched_rule``. Rows of ``docs`` that repeat
    each other each have their signals; a rule that comes twice counts twice, as in ``load_catalogue``.
    Documents meet only rules whose word they hold; rules without a word meet every document.
    """
    rules = rules.select("document_type", "pattern", "base", "ord").where("document_type IS NOT NULL AND pattern IS NOT NULL")
    kinds = rules.groupBy("document_type").agg(
        F.count(F.lit(1)).alias("_size"),
        F.coalesce(F.min(F.struct("ord", "pattern", "base"))["base"].cast("double"), F.lit(0.0)).alias("_base"))
    table = written(rules.groupBy("document_type", "pattern").agg(F.count(F.lit(1)).alias("_copies"), F.min(F.struct("ord")).alias("_ord"))
                    .withColumn("word", literal_word(F.col("pattern"))), "rules")
    worded = table.where("word <> ''")
    row = written(docs.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text")).withColumn(
        "_row", F.monotonically_increasing_id()), "rule-texts")

    found = row.select("_row", F.explode(word_finder(word_heads(worded, most_heads))(F.col("_text"))).alias("_word"))
    hits = lookup_join(found, worded, "_word", "word", ["_row"], "inner").drop("_word")
    always = table.where("word = ''").drop("word")
    if not always.isEmpty():
        hits = hits.unionByName(row.select("_row").crossJoin(always))
    tested = row.join(hits, "_row").where(F.rlike(F.col("_text"), F.concat(F.lit("(?idU)"), F.col("pattern"))))
    first = F.min(F.struct("_ord", "pattern"))
    signals = tested.groupBy("_row", "document_type").agg(
        F.first(key).alias(key), F.sum("_copies").alias("_hits"), first["pattern"].alias("matched_rule"))
    signals = lookup_join(signals.withColumnRenamed("document_type", "_type"), kinds, "_type", "document_type", ["_row"], "inner")
    weight = 0.7 + 0.3 * F.least(F.lit(1.0), F.col("_hits") / F.col("_size") * 4)
    exact = F.least(F.lit(0.99), F.col("_base") * weight)
    score = F.when(exact < 0, -round_half_even(-exact, 4)).otherwise(round_half_even(exact, 4))
    return signals.select(key, F.col("_type").alias("document_type"), score.alias("confidence"), "matched_rule")

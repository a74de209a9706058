"""Rules × pairs.

Rules are known when the plan is built, so a rule table becomes Column expressions
and matching is a narrow step: no join, no shuffle.  Very large rule tables take ``rule_index``.

``first`` keeps the first rule in order, ``all`` keeps every rule that fits.

All pairs pass the key and value tests, in generated code.  The static test and the
similarity ratio are the same for all rules of a pair, so they wait for the few pairs
that fit some rule.  Rules are grouped by their similarity limit; each group offers
its first fitting rule, and the ratio decides between the groups.  It is counted only
where the lengths of key and value leave the decision open.  (An AND does not depend
on the order of its tests.)
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhound.functions import regex
from keyhound.functions.memo import remembered
from keyhound.functions.predicates import (
    all_of,
    any_of,
    has_min_length,
    is_ascii,
    is_base64,
    is_excluded,
    is_literal,
    is_luhn,
    is_named_after_key,
    is_static,
    is_uri,
    passes_similarity,
    similarity_limit,
)
from keyhound.functions.strings import let, lowered_pair, ratio_bound, ratio_of
from keyhound.operators.rule_index import match_indexed, numbered
from keyhound.schemas import KV_COLUMNS
from keyhound.sources.config import ScanConfig
from keyhound.sources.rules import MatchConfig, Rule, rules_from_table, rules_table

log = logging.getLogger(__name__)

Rules = Sequence[Rule] | DataFrame
OrderedRules = tuple[tuple[int, Rule], ...]
MASK_BITS = 60
#: More rules than that are found by a join.  Streams, and runs that also carry failures, keep the narrow form.
MANY_RULES = 300
RULE_FIELDS = ("rule_id", "description", "message", "severity")


def config_tests(text: Column, config: MatchConfig | None) -> tuple[list[Column], list[Column]]:
    """The tests of one side of a rule: cheap ones, then patterns and check digits."""
    cheap: list[Column] = []
    costly: list[Column] = []
    if config is None:
        return cheap, costly
    if config.minlen > 0:
        cheap.append(has_min_length(text, config.minlen))
    if config.is_ascii:
        cheap.append(is_ascii(text))
    if config.regex:
        *guards, pattern = regex.search_tests(text, config.regex, config.ignorecase)
        cheap += guards
        costly.append(pattern)
    if config.is_base64:
        costly.append(is_base64(text))
    if config.is_uri:
        costly.append(is_uri(text))
    if config.is_luhn:
        costly.append(is_luhn(text))
    return cheap, costly


def fits(rule: Rule, key: Column, value: Column) -> Column:
    """The key and value tests of a rule, without the similarity limit."""
    cheap_key, costly_key = config_tests(key, rule.key)
    cheap_value, costly_value = config_tests(value, rule.value)
    return all_of(cheap_key + cheap_value + costly_key + costly_value)


def rule_predicate(rule: Rule, key: Column, value: Column) -> Column:
    """Everything one rule asks of a pair."""
    return fits(rule, key, value) & passes_similarity(key, value, rule.similar)


def usable_rules(df: DataFrame, rules: Rules) -> OrderedRules:
    """Rules with their order.  A rule whose pattern does not compile never matches."""
    listed = rules_from_table(rules) if isinstance(rules, DataFrame) else list(rules)

    def patterns(rule: Rule) -> list[tuple[str, bool]]:
        return [(c.regex, c.ignorecase) for c in (rule.key, rule.value) if c and c.regex]

    valid = regex.valid_patterns(df.sparkSession, [p for r in listed for p in patterns(r)])
    return tuple(
        (order, rule)
        for order, rule in enumerate(listed)
        if all(p in valid for p in patterns(rule))
    )


def keep_scannable(kv: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """Pairs that are not excluded and hold a static value."""
    return drop_excluded(kv, config).filter(is_static(F.col("key"), F.col("value")))


def drop_excluded(kv: DataFrame, config: ScanConfig | None = None, always: str | None = None) -> DataFrame:
    """Pairs no exclusion pattern hits.  Patterns that do not compile are left out.

    Rows with the flag in the column ``always`` stay.
    """
    if config is None:
        return kv
    lists = (config.exclude_keys, config.exclude_values, config.exclude_paths)
    valid = regex.valid_patterns(kv.sparkSession, [(p, True) for ps in lists for p in ps])
    keys, values, paths = ([p for p in ps if (p, True) in valid] for ps in lists)
    if not (keys or values or paths):
        return kv
    columns = (F.col("key"), F.col("value"), F.col("kv_path"))
    kept = ~is_excluded(*columns, keys, values, paths)
    return kv.filter(F.col(always) | kept if always else kept)


def match(
    kv: DataFrame,
    rules: Rules,
    mode: str = "first",
    config: ScanConfig | None = None,
    always: str | None = None,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Pairs with the fields of the rule they match; pairs without a rule are dropped.

    Rows with the flag in the column ``always`` pass untouched, with nulls for the rule.  ``carried`` columns are kept.
    """
    if mode not in ("first", "all"):
        raise ValueError("mode is 'first' or 'all'")
    columns = [*KV_COLUMNS, *carried, *([always] if always else [])]
    candidates = drop_excluded(kv.select(*columns), config, always)
    if not always and not carried and not kv.isStreaming and _are_many(rules):
        # These rules are read in tasks: neither a table of them nor their patterns are held by the driver.
        listed = numbered(rules) if isinstance(rules, DataFrame) else rules_table(kv.sparkSession, list(rules))
        return match_indexed(candidates, listed, mode)
    usable = usable_rules(kv, rules)
    passing = F.col(always) if always else F.lit(False)
    if not usable:
        nothing = [F.lit(None).cast("string").alias(n) for n in RULE_FIELDS]
        return candidates.filter(passing).select("*", F.lit(-1).alias("rule_order"), *nothing)
    # Unfolding an array computes what is in it once, here for all pairs and below for
    # those that fit; a filter on a computed column would compute it twice.
    offered = candidates.select(*columns, F.inline(F.array(_offers(usable, mode))))
    fitting, orders = _fits_any(usable, mode), _orders(usable, mode)
    if always:
        fitting, orders = passing | fitting, F.when(passing, F.array(F.lit(-1))).otherwise(orders)
    return (
        offered.filter(fitting)
        .select(*columns, F.explode(orders).alias("rule_order"))
        .select("*", *[_rule_field(usable, n).alias(n) for n in RULE_FIELDS])
    )


def _are_many(rules: Rules) -> bool:
    return (rules.limit(MANY_RULES + 1).count() if isinstance(rules, DataFrame) else len(rules)) > MANY_RULES


def _groups(rules: OrderedRules) -> dict[float, list[tuple[int, Rule]]]:
    groups: dict[float, list[tuple[int, Rule]]] = {}
    for order, rule in rules:
        groups.setdefault(similarity_limit(rule.similar), []).append((order, rule))
    return groups


def _masks(rules: OrderedRules) -> list[tuple[int, OrderedRules]]:
    return [(i, rules[i : i + MASK_BITS]) for i in range(0, len(rules), MASK_BITS)]


@remembered
def _offers(rules: OrderedRules, mode: str) -> Column:
    """What the key and value tests say: ``offer…`` is the first fitting rule of a group
    (``first``), or a bit for each fitting rule (``all``)."""
    key, value = F.col("key"), F.col("value")
    if mode == "first":
        offers = [_first_fitting(members, key, value) for members in _groups(rules).values()]
    else:
        offers = [
            sum(
                (
                    F.when(fits(rule, key, value), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
                    for bit, (_, rule) in enumerate(part)
                ),
                F.lit(0).cast("long"),
            )
            for _, part in _masks(rules)
        ]
    return F.struct(*[offer.alias(f"offer{i}") for i, offer in enumerate(offers)])


def _first_fitting(members: list[tuple[int, Rule]], key: Column, value: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(0))
    for order, rule in members:
        chain = chain.when(fits(rule, key, value), F.lit(order))
    return chain


@remembered
def _fits_any(rules: OrderedRules, mode: str) -> Column:
    if mode == "first":
        return any_of([F.col(f"offer{i}").isNotNull() for i in range(len(_groups(rules)))])
    return any_of([F.col(f"offer{i}") != 0 for i in range(len(_masks(rules)))])


@remembered
def _orders(rules: OrderedRules, mode: str) -> Column:
    """The orders of the matching rules of a pair that fits some rule."""
    key, value = F.col("key"), F.col("value")
    passing = _first_passing(rules) if mode == "first" else _all_passing(rules)

    def decide(pair: Column) -> Column:
        static = is_literal(value) & ~is_named_after_key(pair["left"], pair["right"])
        return F.when(static, passing(pair))

    return let(lowered_pair(key, value), decide)


def _first_passing(rules: OrderedRules) -> Callable[[Column], Column]:
    offers = [(limit, F.col(f"offer{i}")) for i, limit in enumerate(_groups(rules))]

    def winner(ratio: Column) -> Column:
        picks = [F.when(ratio < limit, offer) for limit, offer in offers]
        return F.least(*picks) if len(picks) > 1 else picks[0]

    def passing(pair: Column) -> Column:
        def decided(bound: Column) -> Column:
            is_open = any_of([offer.isNotNull() & (bound >= limit) for limit, offer in offers])
            return let(F.when(is_open, ratio_of(pair)).otherwise(bound), winner)

        return F.array_compact(F.array(let(ratio_bound(pair), decided)))

    return passing


def _all_passing(rules: OrderedRules) -> Callable[[Column], Column]:
    limits = F.create_map(
        *[F.lit(x) for order, rule in rules for x in (order, similarity_limit(rule.similar))]
    )
    lowest = min(similarity_limit(rule.similar) for _, rule in rules)
    bits = [
        F.when(F.col(f"offer{i}").bitwiseAND(F.lit(1 << bit)) != 0, F.lit(order))
        for i, (_, part) in enumerate(_masks(rules))
        for bit, (order, _) in enumerate(part)
    ]
    fitting = F.array_compact(F.array(*bits))

    def passing(pair: Column) -> Column:
        def decided(bound: Column) -> Column:
            ratio = F.when(bound >= lowest, ratio_of(pair)).otherwise(bound)
            return let(
                ratio, lambda r: F.filter(fitting, lambda o: r < F.element_at(limits, o))
            )

        return let(ratio_bound(pair), decided)

    return passing


@remembered
def _rule_field(rules: OrderedRules, name: str) -> Column:
    """A field of the matched rule, from a literal table."""
    table = F.create_map(
        *[F.lit(x) for order, rule in rules for x in (order, getattr(rule, name))]
    )
    return F.element_at(table, F.col("rule_order"))


def findings(matched: DataFrame) -> DataFrame:
    """The six columns of a finding."""
    return matched.select(
        F.col("rule_id").alias("RuleID"),
        F.col("description").alias("Description"),
        F.col("file_path").alias("FilePath"),
        F.col("line").alias("LineNumber"),
        F.col("value").alias("Content"),
        F.col("severity").alias("Severity"),
    )

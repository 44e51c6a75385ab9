"""Screening of listing texts: match rule, confidence, matched terms.

The flow is ``candidates`` (joins, candidate filter) -> ``classify`` (terms
found, match rule) -> ``screen`` (suppression, labels). Only the two joins in
``candidates`` shuffle. Descriptions, by far the widest column, are reduced to
two booleans where they are scanned and never cross an exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyscan.functions.buckets import case_sql, first_match
from policyscan.functions.text import (
    NOTHING,
    computed_once,
    has_phrase,
    has_word,
    padded_words,
    term_array,
    terms_in,
)
from policyscan.rules import bank
from policyscan.rules.bank import BUILT_IN, Bank, all_terms, terms

LISTING_COLUMNS = (
    "listing_id",
    "user_id",
    "shop_id",
    "title",
    "taxonomy_id",
    "top_category",
    "past_year_gms",
    "past_year_orders",
    "how_its_made_label",
    "price_usd",
)
EMITTED_RULES = (
    "EXPLICIT_FUR_DECLARATION",
    "TIER1_WITH_FUR_CONTEXT",
    "TIER1_STANDALONE",
    "TIER2_WITH_FUR_CONTEXT",
    "FUR_PRODUCT_TERM_ONLY",
)
POSITIVE_RULES = (*EMITTED_RULES, "TAXIDERMY_FUR_ANIMAL", "SEAL_COMPOUND")


@dataclass(frozen=True)
class Profile:
    """What differs between screening the catalogue and screening reactivated listings."""

    description_faux: str = "faux"
    drop_sculptures: bool = True


CATALOGUE = Profile()
REACTIVATED = Profile("faux_reactivated", drop_sculptures=False)


def _title_vocabulary(rules: Bank) -> tuple[str, ...]:
    animals = (*all_terms(rules.sure_animals), *all_terms(rules.ambiguous_animals))
    return (*animals, *all_terms(rules.counters), *all_terms(rules.claims))


def _listing_vocabulary(rules: Bank) -> tuple[str, ...]:
    others = (*all_terms(rules.excluded), *all_terms(rules.materials), *all_terms(rules.byproducts))
    return (*all_terms(rules.fur_terms), *others)


def _one_of(listed: tuple[str, ...]) -> str:
    return "|".join(listed) or NOTHING


def _faux_near_fur(rules: Bank) -> str:
    words = _one_of(terms(rules.faux_near.get("words", "")))
    near = _one_of(terms(rules.faux_near.get("neighbours", "")))
    return rf" (?:{words}) (?:\w+ )?(?:{near}) "


# The tests below are SQL text: the rule bank makes for hundreds of them, and one
# expression string per result column is built far faster than nested calls.


def _holds(found: str, wanted: tuple[str, ...]) -> str:
    if not wanted:
        return "false"
    return f"arrays_overlap({found}, {term_array(wanted)})"


def in_title(*wanted: str) -> str:
    return _holds("title_terms", wanted)


def in_listing(*wanted: str) -> str:
    return _holds("listing_terms", wanted)


def _any(*tests: str) -> str:
    return f"({' OR '.join(tests) or 'false'})"


def _all(*tests: str) -> str:
    return f"({' AND '.join(tests)})"


def _not(test: str) -> str:
    return f"(NOT {test})"


def sellable(listings: DataFrame) -> DataFrame:
    """Listings that are neither digital nor printed on demand (NULL flags pass)."""
    return listings.filter(
        (F.coalesce("is_digital", F.lit(0)) != 1)
        & (F.coalesce("print_on_demand.is_pod", F.lit(0)) != 1)
    )


def description_claims(
    listings: DataFrame, profile: Profile, *keep: str, rules: Bank = BUILT_IN
) -> DataFrame:
    """Replace descriptions by what they claim about fur."""
    faux = terms(rules.descriptions.get(profile.description_faux, ""))
    real = terms(rules.descriptions.get("real", ""))
    return listings.select(
        *keep,
        has_phrase(F.col("description"), faux, "fur").alias("says_faux"),
        has_phrase(F.col("description"), real, "fur").alias("says_real"),
    )


def candidates(
    listings: DataFrame, tags: DataFrame, taxonomy: DataFrame, rules: Bank = BUILT_IN
) -> DataFrame:
    """Listings whose title or tags hold a candidate term, with tags and category path."""
    tagged = listings.join(tags.select("listing_id", "all_tags"), "listing_id", "left").withColumn(
        "listing_words",
        padded_words(
            F.concat(
                F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("all_tags", F.lit(""))
            )
        ),
    )
    # The filter runs before the second join, which then moves candidates only.
    hits = tagged.filter(F.col("listing_words").rlike(f" (?:{_one_of(all_terms(rules.candidates))}) "))
    placed = hits.join(taxonomy.select("listing_id", "full_path"), "listing_id", "left")
    return placed.filter(
        F.col("full_path").isNull() | ~F.lower("full_path").contains(bank.NOISE_PATH)
    )


def _found(rules: Bank) -> dict[str, Column]:
    """Terms found per surface; everything later is a test on these short arrays."""
    title_words = padded_words(F.col("title"))
    tag_words = padded_words(F.lower("all_tags"))
    override = all_terms(rules.overrides)
    return {
        "title_terms": terms_in(title_words, _title_vocabulary(rules), rules.spellings),
        "listing_terms": terms_in(F.col("listing_words"), _listing_vocabulary(rules), rules.spellings),
        "tag_terms": terms_in(tag_words, all_terms(rules.tag_negation), rules.spellings),
        "faux_near_fur": title_words.rlike(_faux_near_fur(rules)),
        "tags_say_real": F.coalesce(has_word(F.col("all_tags"), override), F.lit(False)),
    }


def find_terms(candidate_listings: DataFrame, rules: Bank = BUILT_IN) -> DataFrame:
    """Candidates with the terms found, computed once for all later filters."""
    keep = [c for c in candidate_listings.columns if c not in ("listing_words", "all_tags")]
    return computed_once(candidate_listings, keep, **_found(rules))


def _counter(rules: Bank, name: str) -> str:
    return in_title(*terms(rules.counters.get(name, "")))


def _ambiguous(rules: Bank, name: str) -> str:
    return in_title(*terms(rules.ambiguous_animals.get(name, "")))


def _fur_term(rules: Bank, *names: str) -> str:
    return in_listing(*all_terms(rules.fur_terms, *names)) if names else "false"


def _unguarded(rules: Bank, name: str, test: str) -> str:
    """A test that holds only without the counter that guards it."""
    guard = rules.guards.get(name)
    return _all(test, _not(_counter(rules, guard))) if guard else test


def _any_animal(rules: Bank, animals: dict[str, str]) -> str:
    """Any of the animals in the title, some of them only without their guards."""
    guarded = [name for name in animals if name in rules.guards]
    others = all_terms({name: listed for name, listed in animals.items() if name not in guarded})
    return _any(
        in_title(*others),
        *[_unguarded(rules, name, in_title(*terms(animals[name]))) for name in guarded],
    )


_SAYS_FAUX_ONLY = "(says_faux AND NOT says_real)"
_EMITTED = "match_rule IN ({})".format(", ".join(f"'{rule}'" for rule in EMITTED_RULES))


def _negated_by_tags(rules: Bank) -> str:
    return _holds("tag_terms", all_terms(rules.tag_negation))


def match_rule(rules: Bank = BUILT_IN) -> Column:
    """The screening decision: the first rule that holds."""
    strong = _any(
        in_title(*rules.claim("strong")), _unguarded(rules, "pelt", in_title(*rules.claim("pelt")))
    )
    weak = _not(strong)
    no_byproduct = _not(in_listing(*all_terms(rules.byproducts)))
    hides = [_all(_ambiguous(rules, animal), _fur_term(rules, hide)) for hide, animal in rules.hide.items()]
    context = _any(_fur_term(rules, *rules.evidence), *hides)
    sure = _any_animal(rules, rules.sure_animals)
    ambiguous = _any_animal(rules, rules.ambiguous_animals)
    return case_sql(
        [
            (in_listing(*all_terms(rules.excluded)), "EXCLUDED_ANGORA"),
            ("faux_near_fur", "EXCLUDED_FAUX_PROXIMITY"),
            (
                _any(_negated_by_tags(rules), _counter(rules, "title_negation"), _SAYS_FAUX_ONLY),
                "EXCLUDED_HARD_NEGATION",
            ),
            (_all(_counter(rules, "pet_memorial"), weak), "EXCLUDED_PET_MEMORIAL"),
            (_all(_counter(rules, "sticker_decal"), weak), "EXCLUDED_STICKER_DECAL"),
            (
                _all(_counter(rules, "fursuit_title"), weak, "(NOT tags_say_real)"),
                "EXCLUDED_FURSUIT",
            ),
            (
                _all(_fur_term(rules, *rules.taxidermy), _any(sure, ambiguous), weak),
                "TAXIDERMY_FUR_ANIMAL",
            ),
            (
                _all(in_title(*rules.claim("explicit")), no_byproduct),
                "EXPLICIT_FUR_DECLARATION",
            ),
            (_all(sure, context), "TIER1_WITH_FUR_CONTEXT"),
            (sure, "TIER1_STANDALONE"),
            (_all(ambiguous, context), "TIER2_WITH_FUR_CONTEXT"),
            (_fur_term(rules, *rules.seal), "SEAL_COMPOUND"),
            (_all(strong, no_byproduct), "FUR_PRODUCT_TERM_ONLY"),
        ],
        "NO_MATCH",
    )


def classify(candidate_listings: DataFrame, rules: Bank = BUILT_IN) -> DataFrame:
    """Candidates with the terms found and the match rule."""
    found = find_terms(candidate_listings, rules)
    return computed_once(found, found.columns, match_rule=match_rule(rules))


def is_positive() -> Column:
    return F.col("match_rule").isin(*POSITIVE_RULES)


def fired_rules(rules: Bank = BUILT_IN) -> dict[str, dict[str, str]]:
    """Every named rule as a test, by list, in the order the lists show them."""
    title = {name: _counter(rules, name) for name in rules.counters}
    first = {"title_negation": title.pop("title_negation")} if "title_negation" in title else {}
    return {
        "tier1_animals": {name: in_title(*terms(listed)) for name, listed in rules.sure_animals.items()},
        "tier2_animals": {name: _ambiguous(rules, name) for name in rules.ambiguous_animals},
        "fur_context": {name: _fur_term(rules, name) for name in rules.fur_terms},
        "negation_terms": {
            **{name: in_listing(*terms(listed)) for name, listed in rules.excluded.items()},
            **{name: _holds("tag_terms", terms(listed)) for name, listed in rules.tag_negation.items()},
            **first,
            "faux_proximity": "faux_near_fur",
            "desc_faux_fur": "says_faux",
            "desc_real_fur": "says_real",
            **title,
        },
        "context_terms": {
            name: in_listing(*terms(listed)) for name, listed in (rules.materials | rules.byproducts).items()
        },
    }


def _rules_of(found: str, table: dict[str, str]) -> str:
    """Names of the rules that the found terms belong to, in the table's order."""
    pairs = [(term, rule) for rule, listed in table.items() for term in terms(listed)]
    if not pairs:
        return "cast(array() AS array<string>)"
    known = f"map_from_arrays({term_array(t for t, _ in pairs)}, {term_array(r for _, r in pairs)})"
    rules = f"transform({found}, term -> try_element_at({known}, term))"
    return f"array_intersect({term_array(table)}, {rules})"


def _unless(test: str, names: str, dropped: str) -> str:
    return f"IF({test}, array_remove({names}, '{dropped}'), {names})"


def matched_terms(rules: Bank = BUILT_IN) -> dict[str, Column]:
    """The five comma lists shown with a result; NULL when nothing matched."""
    negation = fired_rules(rules)["negation_terms"]
    negation["desc_faux_fur"] = _SAYS_FAUX_ONLY
    del negation["desc_real_fur"]
    negations = ", ".join(f"IF({test}, '{rule}', NULL)" for rule, test in negation.items())
    sure = _rules_of("title_terms", rules.sure_animals)
    for name in rules.sure_animals:
        if name in rules.guards:
            sure = _unless(_counter(rules, rules.guards[name]), sure, name)
    context = _rules_of("listing_terms", rules.fur_terms)
    for hide, animal in rules.hide.items():
        context = _unless(_not(_ambiguous(rules, animal)), context, hide)
    shown = {
        "tier1_animals": sure,
        "tier2_animals": _rules_of("title_terms", rules.ambiguous_animals),
        "fur_context": context,
        "negation_terms": f"array({negations})",
        "context_terms": "concat({}, {})".format(
            _rules_of("listing_terms", rules.materials), _rules_of("listing_terms", rules.byproducts)
        ),
    }
    return {
        f"matched_{name}": F.expr(f"nullif(array_join({names}, ', '), '')")
        for name, names in shown.items()
    }


def _suppressed(profile: Profile) -> Column:
    path = F.coalesce("full_path", F.lit(""))
    rule = F.col("match_rule")
    drop = (
        ((rule == "TIER1_STANDALONE") & ~path.rlike(bank.LONE_ANIMAL_PATHS))
        | path.rlike(bank.ELECTRONICS_PATHS)
        | path.rlike(bank.PICTURE_PATHS)
    )
    if profile.drop_sculptures:
        drop |= path.rlike(bank.SCULPTURE_PATHS) & (rule != "EXPLICIT_FUR_DECLARATION")
    return drop


def emitted(classified: DataFrame, profile: Profile) -> DataFrame:
    """Classified listings that are reported."""
    return classified.filter(F.expr(_EMITTED) & ~_suppressed(profile))


# Confidence tiers; the word after the number is the band.
def confidence_tier(rules: Bank = BUILT_IN) -> Column:
    tier2 = "match_rule = 'TIER2_WITH_FUR_CONTEXT'"
    prime = _any(*[_ambiguous(rules, name) for name in rules.tier("prime")])
    rabbit = _all(tier2, _any(*[_ambiguous(rules, name) for name in rules.tier("sampled")]))
    return case_sql(
        [
            (_fur_term(rules, *rules.tier("brand")), "01_HIGH_auction_brand"),
            ("match_rule = 'EXPLICIT_FUR_DECLARATION'", "02_HIGH_explicit_declaration"),
            (_all(tier2, prime), "03_HIGH_fox_mink"),
            (_fur_term(rules, *rules.tier("foreign")), "04_HIGH_non_english"),
            ("match_rule = 'TIER1_WITH_FUR_CONTEXT'", "05_HIGH_tier1_with_context"),
            ("match_rule = 'TIER1_STANDALONE'", "06_HIGH_tier1_standalone"),
            (
                _all(rabbit, "top_category IN ('clothing', 'accessories', 'bags_and_purses')"),
                "07_HIGH_rabbit_sampled_cats",
            ),
            (rabbit, "08_MEDIUM_rabbit_other_cats"),
            (
                _all(
                    tier2, "top_category IN ('clothing', 'accessories', 'craft_supplies_and_tools')"
                ),
                "09_MEDIUM_unsampled_tier2_reviewed",
            ),
            ("match_rule = 'FUR_PRODUCT_TERM_ONLY'", "10_REVIEW_fur_product_term_only"),
            (tier2, "11_REVIEW_unsampled_tier2_other"),
        ],
        "OTHER",
    )


def band_of(tier: Column) -> Column:
    return F.when(tier == "OTHER", tier).otherwise(F.split_part(tier, F.lit("_"), F.lit(2)))


def simple_band(rules: Bank = BUILT_IN) -> Column:
    """The band used for reactivated listings; reads species off the raw title."""
    rule = F.col("match_rule")
    tier2 = rule == "TIER2_WITH_FUR_CONTEXT"
    return first_match(
        [
            (
                rule.isin(
                    "EXPLICIT_FUR_DECLARATION", "TIER1_WITH_FUR_CONTEXT", "TIER1_STANDALONE"
                ),
                "HIGH",
            ),
            (tier2 & has_word(F.col("title"), rules.tier("prime")), "HIGH"),
            (
                tier2 & F.col("top_category").isin("clothing", "accessories", "bags_and_purses"),
                "MEDIUM",
            ),
            (tier2 | (rule == "FUR_PRODUCT_TERM_ONLY"), "REVIEW"),
        ],
        "OTHER",
    )


def catalogue_candidates(
    listings: DataFrame,
    tags: DataFrame,
    taxonomy: DataFrame,
    profile: Profile = CATALOGUE,
    rules: Bank = BUILT_IN,
) -> DataFrame:
    described = description_claims(sellable(listings), profile, *LISTING_COLUMNS, rules=rules)
    return candidates(described, tags, taxonomy, rules)


def diagnose_listings(
    listings: DataFrame, tags: DataFrame, taxonomy: DataFrame, rules: Bank = BUILT_IN
) -> DataFrame:
    """Every candidate with its match rule and matched terms, reported or not."""
    classified = classify(catalogue_candidates(listings, tags, taxonomy, rules=rules), rules)
    return classified.select(
        "listing_id",
        "match_rule",
        is_positive().alias("is_fur_trade"),
        *[column.alias(name) for name, column in matched_terms(rules).items()],
    )


def screen_listings(
    listings: DataFrame,
    tags: DataFrame,
    taxonomy: DataFrame,
    ordered: bool = False,
    rules: Bank = BUILT_IN,
) -> DataFrame:
    """Reported listings with match rule, confidence and matched terms."""
    classified = classify(catalogue_candidates(listings, tags, taxonomy, rules=rules), rules)
    result = (
        emitted(classified, CATALOGUE)
        .select(
            *LISTING_COLUMNS,
            "full_path",
            *[column.alias(name) for name, column in matched_terms(rules).items()],
            "match_rule",
            is_positive().alias("is_fur_trade"),
            F.expr(in_title(*rules.claim("vintage"))).alias("is_vintage"),
            confidence_tier(rules).alias("confidence_tier"),
        )
        .withColumn("confidence_band", band_of(F.col("confidence_tier")))
    )
    return result.orderBy(F.desc_nulls_last("past_year_gms"), "listing_id") if ordered else result


def rule_counts(
    listings: DataFrame, tags: DataFrame, taxonomy: DataFrame, rules: Bank = BUILT_IN
) -> DataFrame:
    """How many candidates each named rule fired on.

    One aggregate counts all rules, and its single row is turned into a row per rule.
    """
    # No filter follows, so a projection will do: its values are read, not copied.
    found = catalogue_candidates(listings, tags, taxonomy, rules=rules)
    found = found.select("says_faux", "says_real", *[c.alias(name) for name, c in _found(rules).items()])
    fired = [(group, name, test) for group, named in fired_rules(rules).items() for name, test in named.items()]
    counts = found.agg(*[F.expr(f"count_if({test})").alias(f"n{at}") for at, (_, _, test) in enumerate(fired)])
    listed = ", ".join(
        f"struct('{group}' AS rule_group, '{name}' AS rule, n{at} AS listings)" for at, (group, name, _) in enumerate(fired)
    )
    return counts.select(F.expr(f"inline(array({listed}))"))

"""First-match keyword classification as one Spark SQL expression."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.rules import RuleSet


def constant(value: object, kind: str) -> Column:
    """A nested constant; folded into a literal when the query is optimised.

    One call instead of one per element, which takes longer than small queries.
    """
    return F.from_json(F.lit(json.dumps(value)), kind)


def keyword_pattern(keywords: list[str]) -> str:
    """Regex for the longest keyword starting at a position.

    Shared prefixes are factored out, so the matcher takes at most one branch
    per character instead of trying every keyword in turn.
    """
    tree: dict = {}
    for keyword in keywords:
        node = tree
        for character in keyword:
            node = node.setdefault(character, {})
        node[""] = {}

    def branch(node: dict) -> str:
        options = [re.escape(character) + branch(child) for character, child in node.items() if character]
        if not options:
            return ""
        if "" in node:
            return f"(?:{'|'.join(options)})?"
        return options[0] if len(options) == 1 else f"(?:{'|'.join(options)})"

    return branch(tree)


def _possible_start(keywords: list[str]) -> str:
    """Lookahead for the first characters any keyword begins with.

    Two character classes turn most positions away before the alternatives.
    """

    def any_of(characters: set[str]) -> str:
        return "[" + "".join(re.escape(character) for character in sorted(characters)) + "]"

    starts = [any_of({word[place] for word in keywords}) for place in range(min(2, min(map(len, keywords))))]
    return f"(?={''.join(starts)})"


def contains_any(text: Column, keywords: list[str] | tuple[str, ...]) -> Column:
    """True when the text contains any of a few keywords (case-sensitive).

    Plain searches are faster than a regex up to about a hundred keywords.
    """
    return reduce(Column.__or__, [text.contains(F.lit(keyword)) for keyword in keywords], F.lit(False))


def match_priority(text: Column, rules: RuleSet) -> Column:
    """Priority of the first label with a keyword in the lower-cased text, or null.

    The text is scanned once: the expression collects the longest keyword at
    every position. A keyword hidden in a longer one (another label's ``apart``
    in ``apartment``) is accounted for by giving each keyword the best priority
    among all keywords it contains, so the minimum over the hits equals the
    first matching label of the ordered table.
    """
    priorities = {}
    for priority, (_, keywords) in enumerate(rules.rules):
        for keyword in keywords:
            priorities.setdefault(keyword, priority)
    if not priorities:
        return F.lit(None).cast("int")
    words = list(priorities)
    best = {word: min(priorities[other] for other in words if other in word) for word in words}
    ranks = constant(best, "map<string,int>")
    pattern = f"{_possible_start(words)}(?=({keyword_pattern(words)}))"
    hits = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))
    return F.array_min(F.transform(hits, lambda word: F.element_at(ranks, word)))


def match_label(text: Column, rules: RuleSet) -> Column:
    """First matching label of the rule set, or its default label."""
    if not rules.rules:
        return F.lit(rules.default)
    labels = constant(rules.labels, "array<string>")
    return F.coalesce(F.get(labels, match_priority(text, rules)), F.lit(rules.default))

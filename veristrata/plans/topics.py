"""Topics that no route answers."""

from __future__ import annotations

#: Patterns of the excluded topics, matched without regard to case. A question is refused by
#: them before anything else reads it, so they must be these for the same questions to be refused.
FORBIDDEN_TOPICS = (
    r"\b(?:prevalence|percentage|biological +frequency)\b",
    r"\b(?:screened[- ]negative|biological +absence)\b",
    r"\babsence +(?:of|among|in)\b",
    r"\bno +(?:known +)?(?:EVEs?|endogenous +viral +elements?)\b",
    r"\b(?:EVEs?|endogenous +viral +elements?) +(?:are|were|do|does) +not +(?:present|exist|occur)\b",
    r"\binfect(?:ion|ed|s|ing)?\b",
    r"\b(?:co[- ]?divergence|codivergence)\b",
    r"\bindependent +integration +events?\b",
    r"\b(?:compar(?:e|ed|es|ing|ison|isons)|differ(?:s|ed|ing|ence|ences)?)\b.{0,80}\bhost[- ]lineages?\b",
    r"\bhost[- ]lineages?\b.{0,80}\b(?:compar(?:e|ed|es|ing|ison|isons)|differ(?:s|ed|ing|ence|ences)?)\b",
    r"\b(?:new|de +novo) +(?:EVEs?|endogenous +viral +elements?)\b",
    r"\b(?:detect(?:ed|ing|ion|s)?|identif(?:y|ied|ies|ying|ication)|discover(?:ed|ing|y|ies)?|find(?:ing|s)?)\b.{0,40}\b(?:EVEs?|endogenous +viral +elements?)\b",
    r"\b(?:EVEs?|endogenous +viral +elements?)\b.{0,40}\b(?:detect(?:ed|ing|ion|s)?|identif(?:y|ied|ies|ying|ication)|discover(?:ed|ing|y|ies)?|find(?:ing|s)?)\b",
    r"\b(?:sequence +upload|upload(?:ed|ing)? +(?:a +)?sequence)\b",
    r"\b(?:blast|hmmer|foldseek)\b",
    r"\b(?:phylogeny|phylogenetic|phylogenetically|jplace)\b",
    r"\b(?:live +(?:web +)?search|search +the +web)\b",
    r"\bexternal +knowledge\b",
    r"\b(?:ignor(?:e|ed|es|ing)|overrid(?:e|den|es|ing)|disregard(?:ed|ing|s)?)(?: +the)? +(?:(?:prior|previous|system|developer|answer) +)?instructions?\b",
    r"\b(?:call|invoke|execute|use) +(?:an? +)?(?:external +)?(?:tool|function)s?\b",
    r"\b(?:arbitrary +sql|text[- ]to[- ]sql|sql +query|(?:generate|execute|write|run) +sql)\b",
    r"\bmultilingual +(?:output|quer(?:y|ies))\b",
    r"\bmulti[- ]turn +memory\b",
)

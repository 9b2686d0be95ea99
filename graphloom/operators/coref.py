"""Pronouns and relations resolved in order within an interview."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Words that decide how a mention is resolved.
PRONOUNS = [
    "i", "we", "he", "she", "they", "me", "us", "him", "her", "them", "my", "our", "his", "their", "hers", "theirs", "ourselves", "myself", "themselves", "himself", "herself", "it",
]
SELF, GROUP = {"i", "me", "myself"}, {"we", "us", "ourselves"}
HE, SHE, THEY = {"he", "him", "his"}, {"she", "her", "hers"}, {"they", "them", "their", "theirs"}
OWNED = {"his", "her", "hers", "their", "theirs"}
MALE = [
    "father", "brother", "uncle", "grandfather", "husband", "son", "dad", "papa", "grandpa", "boy", "man", "men", "boys", "sons", "brothers", "uncles", "grandfathers",
]
FEMALE = [
    "mother", "sister", "aunt", "grandmother", "wife", "daughter", "mom", "mama", "grandma", "girl", "woman", "women", "girls", "daughters", "sisters", "aunts", "grandmothers",
]

_STARTS = re.compile(rf"({'|'.join(PRONOUNS)})\b", re.I)
_THIRD = re.compile(rf"({'|'.join(sorted(HE | SHE | THEY))})\b", re.I)
_OWN = re.compile(r"(?:my|our)\s+(.+)$", re.I)
_LETTERS = re.compile(r"[a-zA-Z]+")


class Resolver:
    """State of one interview: the names of its last `lookback` distinct mentions."""

    def __init__(self, survivor: str, gender: str, lookback: int = 10):
        self.survivor, self.gender = survivor or "", gender or ""
        self.recent: deque[str] = deque(maxlen=lookback)

    def _relative(self, text: str) -> str | None:
        """`my X` and `our X` as the survivor's X; None for other texts."""
        own = _OWN.match(text)
        if not own:
            return None
        return f"{self.survivor}'s {own.group(1).strip()}" if self.survivor else text

    def _plain(self, who: str) -> tuple[str, str] | None:
        word = who.lower()
        if not who:
            return who, "empty"
        if word in SELF:
            return self.survivor or who, "rule_self"
        if word in GROUP:
            return (f"{self.survivor} and family" if self.survivor else who), "rule_we"
        if (relative := self._relative(who)) is not None:
            return (relative.rstrip(",.;:") if self.survivor else who), "rule_relational"
        if re.match(r"i[,\s]", who, re.I):
            parts = [p.strip() for p in re.split(r",|\sand\s", who, flags=re.I) if p.strip()]
            named = [(self.survivor or p) if p.lower() in SELF else (self._relative(p) or p) for p in parts]
            return ", ".join(named), "rule_self_compound"
        return None

    def _antecedent(self, first: str) -> str | None:
        newest = list(reversed(self.recent))
        words = {c: set(_LETTERS.findall(c.lower())) for c in newest}
        if first in HE | SHE:
            wanted, sex = (set(MALE), "M") if first in HE else (set(FEMALE), "F")
            for name in newest:
                if words[name] & wanted:
                    return name
            if self.gender == sex and self.survivor in self.recent:
                return self.survivor
        elif first in THEY:
            for name in newest:
                low = name.lower()
                if " and " in low or low.endswith("s") or "family" in low or "parents" in low:
                    return name
        return newest[0] if newest else None

    def __call__(self, mention: str | None) -> tuple[str, str]:
        """(resolved, method) of the next mention."""
        who = (mention or "").strip()
        done = self._plain(who)
        if done is None and _THIRD.match(who):
            first = who.lower().split()[0]
            name = self._antecedent(first)
            done = (who, "unresolved_pronoun") if name is None else (f"{name}'s" if first in OWNED else name, "coref_local")
        resolved, method = done or (who, "original")
        if resolved and method != "empty" and not _STARTS.match(resolved.strip()) and (not self.recent or self.recent[-1] != resolved):
            self.recent.append(resolved)
        return resolved, method


def resolve_mentions(events: DataFrame, key: str, order: list[str], who: str, survivor: str, gender: str, lookback: int = 10) -> DataFrame:
    """events with {who}_original, the resolved {who} and {who}_method.

    Rows are sorted within partitions by key and order and streamed, so that a long
    interview is never held whole; the state between rows is one Resolver.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    fields = [*events.schema.fields, StructField(f"{who}_original", StringType()), StructField(f"{who}_method", StringType())]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), Resolver("", "")
        for part in parts:
            found = []
            for k, mention, name, sex in zip(part[key], part[who], part[survivor], part[gender], strict=True):
                if k != now:
                    now, state = k, Resolver(name, sex, lookback)
                found.append(state(mention))
            part[f"{who}_original"] = part[who]
            part[who] = [r for r, _ in found]
            part[f"{who}_method"] = [m for _, m in found]
            yield part

    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, StructType(fields))

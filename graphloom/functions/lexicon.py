"""Lexicon classifiers: ordered pattern lists, emotion scores, markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import is_nothing, normalise

# Patterns by label, searched in lower-case text.
ACTIVITIES = {
    "deportation": [r"\bdeport", r"\btransport(ed|ation)?\b", r"\bsent to\b.*camp"],
    "forced_labor": [r"\bforced labor\b", r"\bslave labor\b", r"\blabor camp\b", r"\bworked? in.*camp\b"],
    "arrest": [r"\barrest(ed)?\b", r"\bdetain(ed)?\b", r"\bcaptured\b", r"\btaken (away|prisoner)\b"],
    "escape": [r"\bescape[ds]?\b", r"\bfled\b", r"\bran away\b", r"\bhid(e|ing|den)?\b"],
    "liberation": [r"\bliberat(ed|ion)\b", r"\bfreed?\b", r"\breleas(ed|e)\b"],
    "killing": [r"\bkill(ed|ing)?\b", r"\bshot\b", r"\bexecut(ed|ion)\b", r"\bmurder(ed)?\b", r"\bgas(sed|sing)\b"],
    "migration": [r"\bmoved? to\b", r"\bimmigrat(ed|ion)\b", r"\bemigrat(ed|ion)\b", r"\bleft for\b"],
    "education": [r"\bschool\b", r"\bstud(y|ied|ying)\b", r"\bgraduat(ed|ion)\b", r"\buniversity\b"],
    "family_life": [r"\bmarried\b", r"\bborn\b", r"\bfamily\b", r"\bchildren\b", r"\bwedding\b"],
    "hiding": [r"\bin hiding\b", r"\bhidden\b", r"\bhide\b", r"\bshelter(ed)?\b"],
    "resistance": [r"\bresistance\b", r"\bpartisan\b", r"\bfight(ing)?\b.*against\b", r"\bupris(ing|e)\b"],
    "medical": [r"\bhospital\b", r"\bsick\b", r"\bill(ness)?\b", r"\bdoctor\b", r"\btyphus\b"],
    "selection": [r"\bselection\b", r"\bselected\b", r"\bchose\b.*life|death"],
    "testimony": [r"\btestif(y|ied)\b", r"\bwitness(ed|ing)?\b", r"\btestimon(y|ies)\b"],
}
# Ways of travel; patterns by label.
MODES = {
    "train": [r"\bby train\b", r"\btrain\b", r"\brailway\b", r"\bcattle car\b"],
    "truck": [r"\bby truck\b", r"\btruck\b", r"\blorry\b"],
    "foot": [r"\bon foot\b", r"\bwalk(ed|ing)?\b", r"\bmarch(ed|ing)?\b"],
    "wagon": [r"\bwagon\b", r"\bcart\b"],
    "ship": [r"\bby ship\b", r"\bboat\b", r"\bvessel\b", r"\bsail(ed)?\b"],
    "car": [r"\bby car\b", r"\bautomobile\b"],
}
# Causes; patterns by label.
CAUSES = {
    "antisemitic_policy": [r"\banti[- ]?semit", r"\banti[- ]?jew", r"\bnazi\b", r"\bdecree\b", r"\bnuremberg\b", r"\bjewish law\b"],
    "war_operation": [r"\binvasion\b", r"\bwar\b", r"\bfront\b", r"\bbomb(ed|ing)?\b", r"\boccupation\b", r"\bsurrender\b"],
    "survival_need": [r"\bhunger\b", r"\bstarv(ing|ation)\b", r"\bsurviv(e|al)\b", r"\bfood\b"],
    "family_reason": [r"\bfamily\b", r"\bmother\b", r"\bfather\b", r"\bchildren\b", r"\bparent\b"],
    "economic": [r"\bjob\b", r"\bwork\b", r"\bpoverty\b", r"\bmoney\b"],
}
# Historical events; patterns by label.
HISTORICAL = {
    "Kristallnacht": [r"\bkristallnacht\b", r"\bnight of broken glass\b", r"\bnovember (pogrom|1938)\b"],
    "Shoah_Deportations": [r"\bdeport", r"\btransport.*camp\b"],
    "Camp_Liberation": [r"\bliberat(ed|ion)\b", r"\bfreed\b"],
    "Ghettoization": [r"\bghetto\b"],
    "Forced_Marches": [r"\bforced march\b", r"\bdeath march\b"],
    "Invasion_Poland": [r"\binvad(ed|ing)?\s+poland\b", r"\bseptember 1939\b"],
    "Wannsee_Conference": [r"\bwannsee\b"],
    "Nuremberg_Trials": [r"\bnuremberg trial\b"],
    "DDay_Liberation": [r"\bd[- ]?day\b", r"\bnormandy\b"],
    "End_of_War": [r"\bend of.*war\b", r"\bvictory\b", r"\bsurrender\b.*1945"],
}
# Valence, arousal, intensity; the order decides between partial matches.
VAD = {
    "happiness": (0.90, 0.70, 0.80),
    "joy": (0.90, 0.75, 0.80),
    "relief": (0.60, 0.40, 0.50),
    "gratitude": (0.70, 0.50, 0.55),
    "hope": (0.60, 0.60, 0.60),
    "love": (0.85, 0.65, 0.65),
    "pride": (0.75, 0.65, 0.70),
    "sadness": (-0.80, 0.50, 0.70),
    "grief": (-0.90, 0.70, 0.85),
    "sorrow": (-0.85, 0.60, 0.75),
    "fear": (-0.90, 0.80, 0.85),
    "terror": (-0.95, 0.95, 0.90),
    "anxiety": (-0.70, 0.70, 0.65),
    "anger": (-0.80, 0.85, 0.80),
    "rage": (-0.90, 0.95, 0.90),
    "frustration": (-0.60, 0.65, 0.60),
    "disgust": (-0.75, 0.60, 0.65),
    "shame": (-0.70, 0.50, 0.65),
    "guilt": (-0.70, 0.55, 0.70),
    "confusion": (-0.30, 0.50, 0.45),
    "surprise": (0.20, 0.80, 0.60),
    "nostalgia": (0.10, 0.40, 0.50),
    "resignation": (-0.50, 0.30, 0.55),
    "determination": (0.40, 0.70, 0.75),
    "loneliness": (-0.75, 0.40, 0.65),
    "despair": (-0.95, 0.60, 0.85),
    "trauma": (-0.90, 0.75, 0.85),
    "bitterness": (-0.70, 0.55, 0.65),
    "helplessness": (-0.85, 0.50, 0.80),
    "disbelief": (-0.40, 0.65, 0.55),
}
VAD_DEFAULT = (0.0, 0.5, 0.5)
# Words of each category of emotions; patterns by label.
CATEGORIES = {
    "positive": ["happiness", "joy", "relief", "gratitude", "hope", "love", "pride", "determination", "surprise"],
    "negative_high_arousal": ["fear", "terror", "anger", "rage", "despair", "trauma", "helplessness"],
    "negative_low_arousal": ["sadness", "grief", "sorrow", "shame", "guilt", "loneliness", "resignation", "nostalgia", "bitterness"],
}
# Markers in transcripts.
MARKERS = {
    "CRYING": "crying",
    "SOBBING": "sobbing",
    "SIGH": "sighing",
    "LAUGH": "laughing",
    "LAUGHING": "laughing",
    "PAUSE": "pause",
    "LONG PAUSE": "long_pause",
    "SILENCE": "silence",
    "WHISPER": "whispering",
    "WHISPERING": "whispering",
    "SHOUT": "shouting",
    "SHOUTING": "shouting",
    "BREATHING": "heavy_breathing",
    "HEAVY BREATHING": "heavy_breathing",
    "COUGH": "coughing",
    "COUGHING": "coughing",
    "CLEARS THROAT": "clearing_throat",
}


def classify(x: Column, lexicon: dict[str, list[str]]) -> Column:
    """Labels, in the lexicon's order, of which some pattern is found; null: none."""
    text = F.lower(x)
    labels = [F.when(text.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in lexicon.items()]
    return F.array_compact(F.array(*labels))


def lexicon_score(label: Column, lexicon: dict[str, tuple], default: tuple) -> Column:
    """Struct v0, v1, … of the entry equal to the label, else of the first that holds it or is held by it."""

    def entry(values: tuple) -> Column:
        return F.struct(*[F.lit(float(v)).alias(f"v{k}") for k, v in enumerate(values)])

    known = F.create_map(*[c for name, values in lexicon.items() for c in (F.lit(name), entry(values))])

    def score(key: Column) -> Column:
        part = None
        for name, values in lexicon.items():
            test = key.contains(name) | F.lit(name).contains(key)
            part = F.when(test, entry(values)) if part is None else part.when(test, entry(values))
        return F.coalesce(F.element_at(known, key), part.otherwise(entry(default)))

    # the key is made once a label, however many entries it is compared with
    return F.get(F.transform(F.array(F.lower(normalise(label))), score), F.lit(0))


def emotion_category(label: Column) -> Column:
    """positive, negative_high_arousal, negative_low_arousal (in this order) or neutral."""
    key = F.lower(F.trim(label))
    pick = None
    for name, words in CATEGORIES.items():
        test = key.rlike("|".join(words))
        pick = F.when(test, F.lit(name)) if pick is None else pick.when(test, F.lit(name))
    return pick.otherwise("neutral")


def split_emotions(x: Column) -> Column:
    labels = F.filter(F.transform(F.split(x, "[;,]"), lambda c: F.trim(c)), lambda c: (c != "") & ~F.lower(c).isin("not stated", "nan"))
    return F.when(is_nothing(x), F.array().cast("array<string>")).otherwise(labels)


def markers(x: Column, known: dict[str, str] = MARKERS) -> Column:
    """Distinct labels, sorted, of bracketed upper-case markers."""
    found = F.regexp_extract_all(x, F.lit(r"\[([A-Z][A-Z\s]{2,30})\]"), F.lit(1))
    names = F.create_map(*[F.lit(v) for kv in known.items() for v in kv])
    labels = F.transform(found, lambda m: F.element_at(names, F.upper(normalise(m))))
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(labels))), F.array().cast("array<string>"))

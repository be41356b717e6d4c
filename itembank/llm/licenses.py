"""License scans: ordered signature rules behind a gate of needed words, in column expressions only."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.llm.automata import parse
from itembank.llm.common import LOWER, UPPER, documents

#: Fixed values of the base scan: words, and the phrases that count with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: the same words before A-Z are lower-cased
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}

#: License label, pattern of its name, identifiers, address.
FAMILIES = (
    ("mit", r"(?:the )?mit", "mit", r"opensource\.org/licenses/mit"),
    ("apache-2.0", r"apache(?: software)?(?: licen[sc]e)?[, ]+(?:v|version )?2(?:\.0)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", r"apache(?: software)?(?: licen[sc]e)?[, ]+(?:v|version )?1\.1", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache", r"apache(?: software)?", "apache", r"apache\.org/licenses"),
    ("gpl-2.0", r"gpl[- ]?(?:v|version )?2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2"),
    ("gpl-3.0", r"gpl[- ]?(?:v|version )?3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3"),
    ("gpl-2.0", r"(?:gnu )?general public licen[sc]e,? v(?:ersion )?2(?:\.0)?", r"gpl-2", r"gnu\.org/copyleft/gpl-2"),
    ("gpl-3.0", r"(?:gnu )?general public licen[sc]e,? v(?:ersion )?3(?:\.0)?", r"gpl-3", r"gnu\.org/copyleft/gpl-3"),
    ("gpl", r"(?:gnu )?general public", "gpl", r"gnu\.org/licenses/gpl"),
    ("lgpl-2.1", r"(?:gnu )?lesser general public licen[sc]e,? v(?:ersion )?2(?:\.1)?", r"lgpl-2\.[01](?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", r"(?:gnu )?lesser general public licen[sc]e,? v(?:ersion )?3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3"),
    ("lgpl", r"(?:gnu )?lesser general public", "lgpl", r"gnu\.org/licenses/lgpl"),
    ("agpl-3.0", r"(?:gnu )?affero general public licen[sc]e(?:,? v(?:ersion )?3(?:\.0)?)?", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl"),
    ("gfdl", r"(?:gnu )?free documentation", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    ("bsd-2-clause", r"(?:simplified|2-clause|freebsd|two-clause) bsd|bsd[- ]2(?:[- ]clause)?", "bsd-2-clause", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", r"(?:new|modified|revised|3-clause|three-clause) bsd|bsd[- ]3(?:[- ]clause)?", "bsd-3-clause", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", r"(?:original|4-clause|four-clause) bsd|bsd[- ]4(?:[- ]clause)?", "bsd-4-clause", r"directory\.fsf\.org/wiki/license:bsd-4"),
    ("bsd", r"bsd(?:-style)?", "bsd", r"opensource\.org/licenses/bsd"),
    ("mpl-1.1", r"mozilla public licen[sc]e,? v(?:ersion )?1\.1|mpl[- ]?1\.1", r"mpl-1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", r"mozilla public licen[sc]e,? v(?:ersion )?2(?:\.0)?|mpl[- ]?2\.0", r"mpl-2\.0", r"mozilla\.org/mpl/2\.0"),
    ("mpl", r"mozilla public", "mpl", r"mozilla\.org/mpl"),
    ("isc", r"isc", "isc", r"opensource\.org/licenses/isc"),
    ("zlib", r"zlib(?:/libpng)?", "zlib", r"opensource\.org/licenses/zlib"),
    ("boost-1.0", r"boost software", r"bsl-1\.0", r"boost\.org/license_1_0"),
    ("unlicense", r"(?:the )?unlicense", "unlicense", r"unlicense\.org"),
    ("wtfpl", r"wtfpl|do what the f\w+ you want to public", "wtfpl", r"wtfpl\.net"),
    ("artistic-1.0", r"artistic licen[sc]e,? (?:v|version )?1(?:\.0)?", r"artistic-1\.0", r"opensource\.org/licenses/artistic-1"),
    ("artistic-2.0", r"artistic licen[sc]e,? (?:v|version )?2(?:\.0)?", r"artistic-2\.0", r"opensource\.org/licenses/artistic-2"),
    ("epl-1.0", r"eclipse public licen[sc]e,?(?: -)? v(?:ersion )?1(?:\.0)?", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", r"eclipse public licen[sc]e,?(?: -)? v(?:ersion )?2(?:\.0)?", r"epl-2\.0", r"eclipse\.org/legal/epl-2\.0"),
    ("cddl", r"common development and distribution", r"cddl-1\.[01]", r"opensource\.org/licenses/cddl"),
    ("eupl", r"european union public", r"eupl-1\.[12]", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("osl-3.0", r"open software", r"osl-3\.0", r"opensource\.org/licenses/osl-3"),
    ("afl-3.0", r"academic free", r"afl-3\.0", r"opensource\.org/licenses/afl-3"),
    ("ofl-1.1", r"(?:sil )?open font", r"ofl-1\.1", r"scripts\.sil\.org/ofl"),
    ("postgresql", r"postgresql", "postgresql", r"postgresql\.org/about/licence"),
    ("python-2.0", r"python software foundation|psf", r"(?:python|psf)-2\.0", r"docs\.python\.org/\S*license"),
    ("php-3.01", r"php", r"php-3\.01?", r"php\.net/license"),
    ("ruby", r"ruby", "ruby", r"ruby-lang\.org/\S*license"),
    ("ms-pl", r"microsoft public", "ms-pl", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", r"microsoft reciprocal", "ms-rl", r"opensource\.org/licenses/ms-rl"),
    ("ncsa", r"(?:university of illinois/)?ncsa(?: open source)?", "ncsa", r"opensource\.org/licenses/ncsa"),
    ("openssl", r"openssl", "openssl", r"openssl\.org/source/license"),
    ("upl-1.0", r"universal permissive", r"upl-1\.0", r"opensource\.org/licenses/upl"),
    ("odbl-1.0", r"open (?:data commons )?(?:open )?database", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("cc0-1.0", r"(?:creative commons )?cc0(?: 1\.0)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
)
CC_TERMS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Phrases that say something about rights without naming a license.
NOTICES = (
    ("all-rights-reserved", r"\ball rights reserved\b"),
    ("public-domain", r"\b(?:in|into|to) the public domain\b"),
    ("copyright", r"\bcopyright (?:\(c\) |© )?\d{4}\b"),
    ("proprietary", r"\b(?:proprietary and confidential|confidential and proprietary)\b"),
    ("non-commercial", r"\b(?:no|not for|non)[ -]?commercial use\b"),
    ("permissive-grant", r"permission is hereby granted, free of charge"),
    ("warranty-disclaimer", r"\bwithout warranty of any kind\b"),
)
#: Words that so many rules need are searched once in a text, others only where a rule's shared words are there.
SHARED = 3
_ZERO_WIDTH = re.compile(r"\\b|\(\?<?!\[[^\]]*\]\)")


def _needs(tree) -> list[tuple[str, ...]]:
    """What every match of a pattern's tree holds: of each group of words, one at least."""
    if tree[0] == "or":
        chosen = [max(_needs(part), key=lambda words: min(map(len, words)), default=None) for part in tree[1]]
        return [] if None in chosen else [tuple(sorted({w for words in chosen for w in words}))]
    if tree[0] == "rep":
        return _needs(tree[1]) if tree[2] else []
    found, run = [], ""
    for part in [*(tree[1] if tree[0] == "cat" else [tree]), None]:
        if part and part[0] == "set" and len(part[1]) == 1 and min(part[1]) < 128:
            run += chr(min(part[1]))
            continue
        # addresses and identifiers are cut, since many share their first half
        found += [(word,) for word in re.split(r"(?<=[/:])", run) if len(word) > 1]
        run = ""
        if part and part[0] != "set":
            found += _needs(part)
    return list(dict.fromkeys(found))


@dataclass(frozen=True)
class Rule:
    """A rule runs where the words occur that its pattern needs; of overlapping detections the higher priority wins."""

    label: str
    pattern: str
    priority: int

    @property
    def needs(self) -> list[tuple[str, ...]]:
        """Groups of words: a match holds one word of each."""
        return _needs(parse(_ZERO_WIDTH.sub("", self.pattern)))

    @property
    def keyword(self) -> str:
        """The longest word that every match holds, or nothing."""
        return max((words[0] for words in self.needs if len(words) == 1), key=len, default="")


def _spaced(name: str) -> str:
    return name.replace(" ", r"\s+")


def _family_rules(label: str, name: str, spdx: str, url: str) -> list[Rule]:
    """Five signatures of a license, most telling first: identifier, address, grant, release note, plain name."""
    own = f"(?:{_spaced(name)})"
    # the wide rules of a family without a version give way to its versions
    wide = 5 if f"{label}-" in _LABELS else 0
    ending = r"(?:\s+licen[sc]e)?(?![\w-])"
    return [
        Rule(label, rf"spdx-license-identifier:\s*{spdx}(?![\w.+-])", 100),
        Rule(label, url, 90 - wide),
        Rule(label, rf"\blicen[sc]ed\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?{own}{ending}", 80 - wide),
        Rule(label, rf"\b(?:released|distributed|published|available)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?{own}{ending}", 80 - wide),
        Rule(label, rf"(?<![\w-]){own}\s+licen[sc]e(?![\w-])" if wide or label in _PLAIN else rf"(?<![\w-]){own}{ending}", 60 - wide),
    ]


#: names that are ordinary words and mean a license only before that word
_PLAIN = {"mit", "isc", "zlib", "php", "ruby", "openssl", "postgresql", "ncsa", "python-2.0", "osl-3.0", "odbl-1.0", "bsd"}


def _creative_commons() -> list[Rule]:
    rules = []
    for terms in CC_TERMS:
        name = rf"(?:cc|creative\s+commons)[ -]{terms}"
        for version in CC_VERSIONS:
            v = version.replace(".", r"\.")
            label = f"cc-{terms}-{version}"
            rules += [
                Rule(label, rf"spdx-license-identifier:\s*cc-{terms}-{v}(?![\w.+-])", 100),
                Rule(label, rf"creativecommons\.org/licenses/{terms}/{v}", 90),
                Rule(label, rf"\blicensed\s+under\s+(?:a\s+)?{name}[ -]{v}(?![\w-])", 80),
                Rule(label, rf"(?<![\w-]){name}[ -]{v}(?![\w-])", 60),
            ]
        rules.append(Rule(f"cc-{terms}", rf"(?<![\w-]){name}(?![\w-])", 50))
    return rules


_LABELS = " ".join(f[0] for f in FAMILIES)


def rules() -> list[Rule]:
    """All rules in order; order decides between detections alike in priority and place."""
    named = [r for f in FAMILIES for r in _family_rules(*f)]
    return [*named, *_creative_commons(), *[Rule(label, pattern, 20) for label, pattern in NOTICES]]


def _spans(text: Column, rule: Column) -> Column:
    """Where a rule's pattern matches, leftmost and non-overlapping: the gaps between matches give the places."""
    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    gaps = F.split(text, rule["pattern"], -1)
    places = F.transform(
        F.aggregate(
            F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g")),
            F.array().cast("array<struct<start:int,end:int>>"),
            lambda acc, x: F.concat(acc, F.array(_place(acc, x))),
        ),
        lambda p: F.struct(rule["label"].alias("label"), rule["priority"].alias("priority"), rule["number"].alias("number"), p["start"].alias("start"), p["end"].alias("end")),
    )
    return places


def _place(acc: Column, x: Column) -> Column:
    last = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
    start = last + F.length(x["g"])
    return F.struct(start.cast("int").alias("start"), (start + F.length(x["m"])).cast("int").alias("end"))


def detections(low: Column, rule_list: list[Rule] | None = None) -> Column:
    """Detections in a lower-cased text: label, priority, number of the rule, start and end in code points.

    A rule runs where the words that its pattern needs are in the text; words that several rules
    need are searched once. A detection within the interval of another is suppressed when that one
    has a higher priority, or the same and a longer interval, or the same interval and an earlier rule.
    """
    listed = [{**asdict(r), "number": n, "needs": r.needs} for n, r in enumerate(rules() if rule_list is None else rule_list)]
    counts = Counter(words for r in listed for words in r["needs"])
    for r in listed:
        needs = r.pop("needs")
        r["shared"] = [w for w in needs if counts[w] >= SHARED]
        r["own"] = [w for w in needs if counts[w] < SHARED]
    # rules with equal shared needs are asked for together
    sets: dict[str, dict] = {}
    for r in listed:
        shared = r.pop("shared")
        sets.setdefault(json.dumps(shared), {"shared": shared, "rules": []})["rules"].append(r)
    rule = "struct<label:string,pattern:string,priority:int,number:int,own:array<array<string>>>"
    table = F.from_json(F.lit(json.dumps(list(sets.values()))), f"array<struct<shared:array<array<string>>,rules:array<{rule}>>>")
    vocabulary = sorted({w for s in sets.values() for words in s["shared"] for w in words})
    present = F.filter(F.array(*map(F.lit, vocabulary)), lambda w: F.contains(low, w))

    def held(has: Column) -> Column:
        able = F.filter(table, lambda s: F.forall(s["shared"], lambda words: F.arrays_overlap(words, has)))
        asked = F.flatten(F.transform(able, lambda s: s["rules"]))
        told = F.filter(asked, lambda r: F.forall(r["own"], lambda words: F.exists(words, lambda w: F.contains(low, w))))
        return F.flatten(F.transform(told, lambda r: _spans(low, r)))

    # the words present are one element, so that they are searched once
    return F.flatten(F.transform(F.array(present), held))


def unsuppressed(found: Column) -> Column:
    def beats(o: Column, s: Column) -> Column:
        longer, same = (o["end"] - o["start"]) - (s["end"] - s["start"]), o["priority"] == s["priority"]
        inside = (o["start"] <= s["start"]) & (o["end"] >= s["end"])
        return inside & ((o["priority"] > s["priority"]) | (same & ((longer > 0) | ((longer == 0) & (o["number"] < s["number"])))))

    return F.filter(found, lambda s: ~F.exists(found, lambda o: beats(o, s)))


def phrase_places(words: Column) -> Column:
    """label and start (in words, from 0) of every place of a base phrase, by start."""
    every = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    parts = []
    for label, phrase in PHRASES.items():
        parts.append(F.transform(F.filter(every, _says(words, phrase)), _labelled(label)))
    return F.array_sort(F.concat(*parts))


def _says(words: Column, phrase: tuple[str, ...]):
    def at(i: Column) -> Column:
        says = F.lit(True)
        for k, word in enumerate(phrase):
            says = says & (F.get(words, i + k) == word)
        return says

    return at


def _labelled(label: str):
    return lambda i: F.struct(i.alias("start"), F.lit(label).alias("label"))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (base phrases) and found (detections left after suppression) of every row.

    Null and empty texts have no words and no detections; repeated rows and null ids are
    scanned like others. Only column expressions, nothing is shuffled.
    """
    text, low = F.col("text"), F.col("low")
    ascii_low = F.translate(text, UPPER, LOWER)
    # staged, so that words and detections are made once however often the lambdas look at them
    staged = documents(docs).withColumn("low", F.lower(text)).select(
        "doc_id",
        F.regexp_count(text, F.lit(CASED_WORD)).cast("long").alias("n_words"),
        F.when(F.contains(low, F.lit("license")), F.regexp_extract_all(ascii_low, F.lit(WORD), F.lit(0)))
        .otherwise(F.array().cast("array<string>")).alias("words"),
        detections(low).alias("raw"),
    )
    return staged.select("doc_id", "n_words", phrase_places(F.col("words")).alias("places"), unsuppressed(F.col("raw")).alias("found"))


def license_report(docs: DataFrame) -> DataFrame:
    """Counts, labels and a score per document: the best priority of its detections, as a share of 100."""
    places, found = F.col("places"), F.col("found")
    starts = F.transform(places, lambda p: p["start"].cast("long"))
    base = F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"])))
    every = F.array_sort(F.array_distinct(F.concat(base, F.transform(found, lambda f: f["label"]))))
    best = F.array_max(F.concat(F.transform(found, lambda f: f["priority"]), F.transform(places, lambda _: F.lit(60))))
    return license_scan(docs).select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        (F.coalesce(best, F.lit(0)) / 100.0).alias("score"),
    )

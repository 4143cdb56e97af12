"""License scans with ordered signature rules, as native expressions: one map over whole texts, no shuffle, no Python.

Base detections are places where the words of a phrase stand one after the other. Over them, some hundreds of regular
expressions are tried, each only on texts that hold its keyword. Where detections overlap, one that lies inside another
of its priority or a higher one is suppressed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base: phrases and labels, and what a word is once A-Z are lower case.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HIT = "struct<start:int,back:int,rank:int,label:string,score:double,level:int>"  # back and rank are stop and priority, negative so that both sort downwards
GAP = r"[\s#*/;%-]+"  # between the words of a sentence
OPEN, CLOSE = "\x01", "\x02"  # set around matches; blanks stand for them in what is scanned


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str  # lower case; a text without it can't match
    priority: int
    score: float
    pattern: str  # on text in lower case


def rules() -> list[Rule]:
    """Signatures, highest priority first: identifiers, titles with versions, then titles, then hints."""
    out: list[Rule] = []
    gap = r"[\s,;()\"'*#-]{0,6}"

    def family(label: str, title: str, keyword: str, short: str, versions: tuple[str, ...]) -> None:
        for v in versions:
            name, n = f"{label}-{v}", v.replace(".", r"\.").removesuffix(r"\.0") + (r"(?:\.0)?" if v.endswith(".0") else "")
            end = r"(?![0-9]|\.[0-9])"
            out.append(Rule(name, keyword, 80, 0.95, rf"{title}{gap}(?:version{gap}|v\.?\s?)?{n}{end}"))
            out.append(Rule(name, keyword, 85, 0.95, rf"version{gap}{n}{end}\s+of\s+the\s+{title}"))
            out.append(Rule(f"{name}-or-later", keyword, 90, 0.97, rf"{title}{gap}(?:version{gap}|v\.?\s?)?{n}{gap}(?:\(?at your option\)?{gap})?or{gap}(?:\(?at your option\)?{gap})?(?:any )?later"))
            if short:
                out.append(Rule(name, short, 70, 0.85, rf"\b{short}(?:\s?v|[\s-]){n}{end}"))
                out.append(Rule(f"{name}-or-later", short, 75, 0.9, rf"\b{short}(?:\s?v|[\s-]){n}(?:\+|-or-later)"))
        out.append(Rule(label, keyword, 50, 0.8, title))

    gpl = r"general\s+public\s+licen[cs]e"
    family("gpl", rf"(?<!lesser )(?<!library )(?<!affero ){gpl}", "public", "gpl", ("1.0", "2.0", "3.0"))
    family("lgpl", rf"(?:lesser|library)\s+{gpl}", "public", "lgpl", ("2.0", "2.1", "3.0"))
    family("agpl", rf"affero\s+{gpl}", "affero", "agpl", ("1.0", "3.0"))
    family("apache", r"apache\s+(?:software\s+)?licen[cs]e", "apache", "apache", ("1.0", "1.1", "2.0"))
    family("mpl", r"mozilla\s+public\s+licen[cs]e", "mozilla", "mpl", ("1.0", "1.1", "2.0"))
    family("epl", r"eclipse\s+public\s+licen[cs]e", "eclipse", "epl", ("1.0", "2.0"))
    family("eupl", r"european\s+union\s+public\s+licen[cs]e", "european", "eupl", ("1.0", "1.1", "1.2"))
    family("cddl", r"common\s+development\s+and\s+distribution\s+licen[cs]e", "distribution", "cddl", ("1.0", "1.1"))
    family("osl", r"open\s+software\s+licen[cs]e", "software", "osl", ("1.0", "2.0", "2.1", "3.0"))
    family("afl", r"academic\s+free\s+licen[cs]e", "academic", "afl", ("1.1", "1.2", "2.0", "2.1", "3.0"))
    family("gfdl", r"free\s+documentation\s+licen[cs]e", "documentation", "gfdl", ("1.1", "1.2", "1.3"))
    family("artistic", r"artistic\s+licen[cs]e", "artistic", "", ("1.0", "2.0"))
    family("bsl", r"boost\s+software\s+licen[cs]e", "boost", "", ("1.0",))
    family("lppl", r"latex\s+project\s+public\s+licen[cs]e", "latex", "lppl", ("1.0", "1.2", "1.3"))
    family("python", r"python(?:\s+software\s+foundation)?\s+licen[cs]e", "python", "", ("2.0",))

    terms = {"by": "attribution", "by-sa": "attribution-?share-?alike", "by-nd": "attribution-?no-?deriv(?:ative)?s?", "by-nc": "attribution-?non-?commercial", "by-nc-sa": "attribution-?non-?commercial-?share-?alike", "by-nc-nd": "attribution-?non-?commercial-?no-?deriv(?:ative)?s?"}
    for code, words in terms.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            n, name = v.replace(".", r"\."), f"cc-{code}-{v}"
            out.append(Rule(name, "cc", 80, 0.95, rf"\bcc[\s-]{code.replace('-', '[ -]')}[\s-]{n}(?![0-9])"))
            out.append(Rule(name, "creativecommons", 90, 0.98, rf"creativecommons\.org/licenses/{code}/{n}"))
            out.append(Rule(name, "creative", 85, 0.95, rf"creative\s+commons\s+{words.replace('-?', '[ -]?')}{gap}{n}"))
        out.append(Rule(f"cc-{code}", "cc", 55, 0.8, rf"\bcc[\s-]{code.replace('-', '[ -]')}\b(?![\s-](?:nc|nd|sa|[0-9]))"))
    out += [Rule("cc0-1.0", "cc0", 80, 0.95, r"\bcc0(?:[\s-]1\.0)?\b"), Rule("cc0-1.0", "publicdomain", 90, 0.98, r"creativecommons\.org/publicdomain/zero/1\.0")]

    names = ("mit", "isc", "zlib", "unlicense", "wtfpl", "0bsd", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "apache-2.0", "mpl-2.0", "epl-2.0", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "lgpl-2.1-only", "lgpl-3.0-only", "agpl-3.0-only", "cc-by-4.0", "cc-by-sa-4.0", "cc0-1.0", "bsl-1.0")
    out += [Rule(x.replace("-only", ""), "spdx", 100, 1.0, rf"spdx-license-identifier:\s*{x.replace('.', '[.]')}(?![a-z0-9.+-])") for x in names]
    for n, word in (("2", "two"), ("3", "three"), ("4", "four")):
        out += [Rule(f"bsd-{n}-clause", "bsd", 80, 0.95, rf"\b(?:{n}|{word})[\s-]clause\s+bsd"), Rule(f"bsd-{n}-clause", "bsd", 80, 0.95, rf"\bbsd[\s-](?:{n}|{word})[\s-]clause")]
    for short, keyword in (("mit", "mit"), ("isc", "isc"), ("bsd", "bsd"), ("zlib", "zlib"), ("x11", "x11"), ("wtfpl", "wtfpl"), ("postgresql", "postgresql"), ("unlicense", "unlicense"), ("beerware", "beer")):
        out += [Rule(short, keyword, 60, 0.9, rf"(?:released|licen[cs]ed|distributed|available)\s+under\s+(?:the\s+)?(?:terms\s+of\s+the\s+)?{short}\s+licen[cs]e"), Rule(short, keyword, 50, 0.8, rf"\b{short}[\s-]licen[cs]e")]
    out = [replace(r, pattern=gaps(r.pattern)) for r in out + texts()]
    spdx = r"[a-z0-9.+-]+"
    out += [
        Rule("spdx-either", "spdx", 105, 1.0, rf"spdx-license-identifier:\s*\(?{spdx}(?:\s+or\s+{spdx})+\)?"),
        Rule("spdx-both", "spdx", 105, 1.0, rf"spdx-license-identifier:\s*\(?{spdx}(?:\s+and\s+{spdx})+\)?"),
        Rule("spdx-exception", "spdx", 106, 1.0, rf"spdx-license-identifier:\s*\(?{spdx}\s+with\s+[a-z0-9.-]+-exception[a-z0-9.-]*\)?"),
        Rule("dual", "licen", 88, 0.9, r"(?:dual|double|multi)[\s-]licen[cs]ed\s+(?:under|as)\s+(?:the\s+)?(?:mit|bsd|gpl|lgpl|apache|mpl)[a-z0-9 .-]{0,12}?\s+(?:and|or)\s+(?:the\s+)?(?:mit|bsd|gpl|lgpl|apache|mpl)"),
    ]
    return sorted(out, key=lambda r: (-r.priority, r.label, r.pattern))


def gaps(pattern: str) -> str:
    """The pattern with every blank as a gap: sentences wrap anywhere, and in files comment marks stand before each line."""
    pattern = pattern.replace("[ -]", r"[\s-]").replace(r"\s+", GAP)
    return pattern if "(?<!" in pattern else pattern.replace(" ?", GAP[:-1] + "*").replace(" ", GAP)


def texts() -> list[Rule]:
    """Sentences of licences, notices and file headers, known by one of their rarer words; blanks become gaps."""
    return [
        # permission notices
        Rule("mit", "limitation", 70, 0.97, r"without limitation the rights\s+to use, copy, modify"),
        Rule("mit", "permission", 72, 0.97, r"the above copyright notice and this permission notice shall be included in all\s+copies"),
        Rule("isc", "hereby", 72, 0.97, r"permission to use, copy, modify,? and(?:/or)? distribute this software for any\s+purpose\s+with or without fee is hereby granted"),
        Rule("hpnd", "hereby", 71, 0.85, r"permission to use, copy, modify,? (?:and )?distribute this software and its documentation for any purpose\s+(?:and )?without fee is hereby granted"),
        Rule("zlib", "altered", 72, 0.97, r"altered source versions must be plainly marked as such"),
        Rule("zlib", "misrepresented", 71, 0.95, r"the origin of this software must not be misrepresented"),
        Rule("bsl-1.0", "accompanying", 72, 0.97, r"person or organization\s+obtaining a copy of the software and accompanying documentation"),
        Rule("unlicense", "unencumbered", 72, 0.98, r"this is free and unencumbered software released into the public domain"),
        Rule("wtfpl", "just", 72, 0.95, r"you just do what the f\S+ you want to"),
        Rule("beerware", "worth", 72, 0.97, r"if we meet some day, and you think\s+this stuff is worth it"),
        Rule("json", "evil", 74, 0.98, r"the software shall be used for good, not evil"),
        Rule("cc0-1.0", "neighboring", 72, 0.9, r"waived all copyright and related or neighboring rights"),
        # conditions
        Rule("bsd", "redistribution", 70, 0.9, r"redistribution and use in source and binary forms"),
        Rule("bsd-3-clause", "endorse", 73, 0.95, r"neither the name of [^.]{1,120}? nor the names of its\s+contributors may be used to endorse or promote products"),
        Rule("bsd-4-clause", "advertising", 74, 0.96, r"all advertising materials mentioning features or use of this software\s+must display"),
        Rule("apache-1.1", "derived", 74, 0.96, r"products derived from this software may not be called \"apache\""),
        Rule("openssl", "openssl", 74, 0.97, r"developed by the openssl project for use in the openssl toolkit"),
        Rule("gpl", "verbatim", 71, 0.85, r"everyone is permitted to copy and distribute verbatim copies of this license document"),
        # file headers
        Rule("apache-2.0", "applicable", 74, 0.95, r"unless required by applicable law or agreed to in writing, software\s+distributed under the license is distributed on an \"as is\" basis"),
        Rule("apache-2.0", "apache.org/licenses", 86, 0.98, r"apache\.org/licenses/license-2\.0"),
        Rule("apache", "asf", 73, 0.85, r"licensed to the apache software foundation \(asf\) under one\s+or more contributor license agreements"),
        Rule("gpl", "redistribute", 71, 0.9, r"this program is free software[:;]? (?:you can|it may be) redistribute(?:d)? (?:it )?and/?(?:or)? ?modif(?:y|ied)"),
        Rule("lgpl", "redistribute", 71, 0.9, r"this library is free software[:;]? you can redistribute it and/or\s+modify it"),
        Rule("gpl", "gnu", 70, 0.85, r"you should have received a copy of the gnu general public licen[cs]e"),
        Rule("lgpl", "gnu", 73, 0.9, r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
        Rule("agpl", "gnu", 73, 0.9, r"you should have received a copy of the gnu affero general public licen[cs]e"),
        Rule("mpl-2.0", "mozilla", 74, 0.97, r"this source code form is subject to the terms of the mozilla public\s+license, v\. 2\.0"),
        Rule("mpl-1.1", "mozilla", 74, 0.95, r"the contents of this file are subject to the mozilla public license\s+version 1\.1"),
        Rule("cddl", "distribution", 74, 0.93, r"the contents of this file are subject to the terms of the\s+common development and distribution license"),
        Rule("epl-1.0", "eclipse", 74, 0.95, r"this program and the accompanying materials\s+are made available under the terms of the eclipse public license v(?:ersion )?1\.0"),
        Rule("epl-2.0", "eclipse", 74, 0.95, r"this program and the accompanying materials\s+are made available under the terms of the eclipse public license (?:v\. ?)?2\.0"),
        Rule("bsd", "governed", 68, 0.8, r"governed by a bsd-style\s+licen[cs]e that can be found in the license file"),
        Rule("mit", "governed", 68, 0.8, r"governed by an? mit-style\s+licen[cs]e that can be found in the license file"),
        # exceptions
        Rule("classpath-exception", "modules", 76, 0.95, r"link this library with independent modules to produce an executable"),
        Rule("gcc-exception", "gcc", 76, 0.95, r"gcc runtime library exception"),
        Rule("llvm-exception", "llvm", 76, 0.95, r"apache licen[cs]e v2\.0 with llvm exceptions"),
        Rule("bison-exception", "bison", 76, 0.95, r"as a special exception, you may create a larger work that contains\s+part or all of the bison parser skeleton"),
        Rule("autoconf-exception", "autoconf", 76, 0.95, r"as a special exception[^.]{0,80}? configuration script generated by autoconf"),
        Rule("font-exception", "embed", 76, 0.95, r"if you create a document which uses this font, and embed this font"),
        Rule("openssl-exception", "openssl", 76, 0.93, r"permission to link (?:the code of )?(?:this|portions of this) program with the openssl library"),
        # licences known by their titles alone
        Rule("ofl-1.1", "font", 60, 0.9, r"sil open font licen[cs]e"),
        Rule("ms-pl", "microsoft", 60, 0.9, r"microsoft public licen[cs]e"),
        Rule("ms-rl", "microsoft", 60, 0.9, r"microsoft reciprocal licen[cs]e"),
        Rule("elastic-2.0", "elastic", 60, 0.9, r"elastic licen[cs]e(?: 2\.0)?"),
        Rule("busl-1.1", "business", 60, 0.9, r"business source licen[cs]e(?: 1\.1)?"),
        Rule("sspl-1.0", "server", 60, 0.9, r"server side public licen[cs]e"),
        Rule("commons-clause", "clause", 60, 0.9, r"commons clause licen[cs]e condition"),
        Rule("polyform", "polyform", 60, 0.9, r"polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e"),
        Rule("odbl-1.0", "database", 60, 0.9, r"open (?:data commons )?(?:open )?database licen[cs]e"),
        Rule("cecill", "cecill", 60, 0.9, r"cecill(?:-[bc])?(?:[\s-](?:version\s)?[12]\.[01])?\s+licen[cs]e"),
        Rule("upl-1.0", "permissive", 60, 0.9, r"universal permissive licen[cs]e"),
        Rule("ncsa", "ncsa", 60, 0.9, r"(?:university of illinois/)?ncsa open source licen[cs]e"),
        Rule("vim", "vim", 60, 0.9, r"\bvim licen[cs]e"),
        Rule("ruby", "ruby", 60, 0.9, r"\bruby licen[cs]e"),
        Rule("php-3.01", "php", 60, 0.9, r"\bphp licen[cs]e(?:,? version 3\.01)?"),
        # hints
        Rule("public-domain", "domain", 40, 0.7, r"(?:placed|released|dedicated)\s+(?:in|into|to)\s+the\s+public\s+domain"),
        Rule("proprietary", "reserved", 30, 0.6, r"all\s+rights\s+reserved"),
        Rule("proprietary", "confidential", 30, 0.6, r"proprietary\s+and\s+confidential"),
        Rule("proprietary", "commercial", 30, 0.6, r"not\s+for\s+commercial\s+use"),
        Rule("proprietary", "secret", 35, 0.7, r"(?:contains|constitutes)\s+(?:the\s+)?(?:confidential\s+)?trade secrets?\s+of"),
        Rule("no-redistribution", "redistribution", 35, 0.7, r"(?:redistribution|copying)\s+(?:of this file\s+)?is\s+(?:strictly\s+)?(?:prohibited|not permitted)"),
    ]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body's functions use it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def base_places(text: Column) -> Column:
    """Array of structs (at, label): the place of each base phrase's first word, for text in lower case."""
    place = "array<struct<at:int,label:string>>"

    def phrases(w: Column, i: Column) -> Column:
        # each phrase ends in the same word, where w[i] stands
        found = []
        for phrase, label in BASE:
            *head, _ = phrase.split(" ")
            same = [F.get(w, i - len(head) + k) == x for k, x in enumerate(head)]
            hit = same[0]
            for s in same[1:]:
                hit = hit & s
            found.append(F.when(hit & (i >= len(head)), F.struct((i - len(head)).alias("at"), F.lit(label).alias("label"))))
        return F.array_compact(F.array(*found))

    last = {p.split(" ")[-1] for p, _ in BASE}
    assert len(last) == 1

    def places(w: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i) == last.copy().pop())
        return F.when(F.size(w) > 0, F.flatten(F.transform(ends, lambda i: phrases(w, i)))).otherwise(F.array().cast(place))

    return let(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), places).cast(place)


def detections(text: Column, signatures: list[Rule]) -> Column:
    """Array of structs (start, stop, priority, label, score) that are left after suppression, by start."""
    levels = sorted({r.priority for r in signatures})

    def row(r: Rule) -> dict:
        return {"level": levels.index(r.priority), "priority": r.priority, "label": r.label, "score": r.score, "pattern": r.pattern}

    keywords = sorted({r.keyword for r in signatures})
    groups = [{"keyword": k, "rules": [row(r) for r in signatures if r.keyword == k]} for k in keywords]
    # one literal; Spark parses it once
    table = F.from_json(F.lit(json.dumps(groups)), "array<struct<keyword:string,rules:array<struct<level:int,priority:int,label:string,score:double,pattern:string>>>>")

    def of_rule(t: Column, r: Column) -> Column:
        marked = F.split(F.regexp_replace(t, r["pattern"], F.lit(f"{OPEN}$0{CLOSE}")), F.lit(OPEN))

        def step(acc: Column, part: Column) -> Column:
            n = F.instr(part, CLOSE) - 1
            hit = F.struct(acc["at"].alias("start"), (-acc["at"] - n).alias("back"), (-r["priority"]).alias("rank"), r["label"].alias("label"), r["score"].alias("score"), r["level"].alias("level"))
            return F.struct((acc["at"] + F.length(part) - F.when(n >= 0, 1).otherwise(0)).alias("at"), F.when(n > 0, F.concat(acc["hits"], F.array(hit.cast(HIT)))).otherwise(acc["hits"]).alias("hits"))

        return F.aggregate(marked, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{HIT}>").alias("hits")), step, lambda acc: acc["hits"])

    of_group = lambda t, g: F.flatten(F.transform(g["rules"], lambda r: of_rule(t, r)))
    hits = let(text, lambda t: F.flatten(F.transform(F.filter(table, lambda g: F.contains(t, g["keyword"])), lambda g: of_group(t, g))))
    return F.transform(suppress(hits, len(levels)), lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("stop"), (-x["rank"]).alias("priority"), x["label"].alias("label"), x["score"].alias("score")))


def suppress(hits: Column, n_levels: int) -> Column:
    """Of hits (``HIT``) those that lie in no other of their priority or a higher one, by start, then the longer first; of hits with one place the
    one of the highest priority, then the first by label.

    In that order every interval comes after all that contain it. ``reach`` has for each level the furthest end of the hits of that
    level or a higher one so far; what is suppressed needs no place in it, as something further reaching is there already.
    """

    def step(acc: Column, x: Column) -> Column:
        stop = -x["back"]
        inside = F.get(acc["reach"], x["level"]) >= stop
        reach = F.transform(acc["reach"], lambda r, i: F.when(i <= x["level"], F.greatest(r, stop)).otherwise(r))
        return F.struct(reach.alias("reach"), F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"))

    start = F.struct(F.array_repeat(F.lit(-1), n_levels).alias("reach"), F.array().cast(f"array<{HIT}>").alias("kept"))
    return F.aggregate(F.array_sort(hits), start, step, lambda acc: acc["kept"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base, found) per row: base places (at, label) in words, detections of the rules in code points.

    Null text counts as empty: no words, empty arrays. Texts of any length are scanned whole. Of detections that start together
    the longest comes first; of those with one place that of the highest priority stays, then the first by label. Repeated
    rows give repeated rows, an empty table none; other columns are not read.
    """
    signatures = rules()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.translate(F.col("text"), UPPER + OPEN + CLOSE, LOWER + "  ")
    keywords = sorted({r.keyword for r in signatures})
    plain = F.lower("text")
    gate = F.lit(False)
    for k in [k for k in keywords if not any(o != k and o in k for o in keywords)]:
        gate = gate | F.contains(F.col("plain"), F.lit(k))
    place, found = "array<struct<at:int,label:string>>", "array<struct<start:int,stop:int,priority:int,label:string,score:double>>"
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .withColumn("plain", plain)
        .select(
            "doc_id",
            F.size(F.regexp_extract_all("text", F.lit(f"({WORD_ANY_CASE})"), F.lit(0))).cast("long").alias("n_words"),
            F.when(F.contains("plain", F.lit("license")), base_places(low)).otherwise(F.array().cast(place)).alias("base"),
            F.when(gate, detections(low, signatures)).otherwise(F.array().cast(found)).alias("found"),
        )
    )

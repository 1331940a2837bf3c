"""Signatures of licenses, written over the words of a text.

A text is read as its lower-case words with one space between them, so
``Apache-2.0`` is ``apache 2 0``. A rule's pattern matches whole words. Its gates
are sets of keywords: every text with a match holds all keywords of one set.

Most licenses are named in three ways: by an identifier tag, in a notice such as
"released under the ...", and by their title alone. Their rules are built from
the title and the identifier in ``NAMES``. ``TEXTS`` are further signatures:
addresses, sentences of license texts, and general statements.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A signature. Of two detections, one inside the other, the higher priority stays; ``strength`` is its part in the score."""

    name: str
    label: str
    pattern: str
    gates: tuple[tuple[str, ...], ...]
    priority: int
    strength: float


#: (priority, strength) of the ways to state a license.
TAG, ADDRESS, NOTICE, SENTENCE, TITLE, GENERAL = (90, 0.99), (80, 0.95), (70, 0.95), (60, 0.9), (40, 0.6), (10, 0.4)

_LIC = "licen[cs]e"
_LATER = "(?: or (?:at your option )?(?:any )?later(?: version)?| only)?"
_UNDER = (
    "(?:(?:(?:sub)?licen[cs]ed|released|distributed|re ?distribute it|available|published|provided|shared) (?:to you )?(?:only )?under"
    "|(?:covered|governed) by) (?:either of )?(?:the )?(?:(?:terms|conditions) (?:and conditions )?of )?(?:the |an? )?"
)
_MARK = "spdx licen[cs]e identifier "


def _v(major: int, minor: int = 0) -> str:
    """A version as ``version 2 0``, ``v2 0`` or ``2 0``; a minor of 0 may be left out."""
    return rf"(?:version |v )?v?{major}" + (f" {minor}" if minor else "(?: 0)?")


def _cc(parts: str, name: str) -> tuple[str, str, str, str, str]:
    version = r"(?: [1-4] [05](?: [a-z]{2,3})?)?"
    title = rf"creative commons {name}(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: public)?(?: {_LIC})?"
    return f"cc-{parts.replace(' ', '-')}", title, f"cc {parts}{version}", "creative commons", f"cc {parts.split()[-1]}"


_ATTRIBUTION, _SHARE = "attribution", "share ?alike"
_NC, _ND = "non ?commercial", "no ?deriv(?:ative|ative work)?s?"

# label, title, identifier, gates of the title, gates of the identifier: words all of which a match holds, or (|) others
NAMES: tuple[tuple[str, str, str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("mit", f"(?:mit|expat)(?: expat| x11)? {_LIC}", "mit", "mit licen|expat licen", "mit"),
    ("mit-0", f"mit no attribution(?: {_LIC})?", "mit 0", "attribution", "mit"),
    ("x11", f"x11 {_LIC}", "x11", "x11", "x11"),
    ("isc", f"isc {_LIC}|internet systems consortium {_LIC}", "isc", "isc licen|consortium licen", "isc"),
    ("apache-2", f"apache (?:software )?{_LIC} {_v(2)}|apache 2 0 {_LIC}", f"apache {_v(2)}", "apache", "apache"),
    ("apache-1.1", f"apache (?:software )?{_LIC} {_v(1, 1)}", f"apache {_v(1, 1)}", "apache", "apache"),
    ("apache", f"apache (?:software )?{_LIC}", "apache", "apache", "apache"),
    ("bsd-0", f"(?:zero|0) clause bsd(?: {_LIC})?", "0bsd", "bsd", "0bsd"),
    ("bsd-2", f"(?:simplified bsd|freebsd|(?:two|2) clause bsd|bsd (?:two|2) clause) {_LIC}", "bsd 2 clause", "bsd", "bsd"),
    ("bsd-3", f"(?:(?:new|modified|revised|(?:three|3) clause) bsd|bsd (?:three|3) clause) {_LIC}", "bsd 3 clause", "bsd", "bsd"),
    ("bsd-4", f"(?:(?:original|old|(?:four|4) clause) bsd|bsd (?:four|4) clause) {_LIC}", "bsd 4 clause", "bsd", "bsd"),
    ("bsd", f"bsd(?: style)? {_LIC}", "bsd", "bsd", "bsd"),
    ("gpl-1", f"(?:gnu )?general public {_LIC} {_v(1)}{_LATER}", f"gpl ?{_v(1)}{_LATER}", "general", "gpl"),
    ("gpl-2", f"(?:gnu )?general public {_LIC} {_v(2)}{_LATER}", f"(?:gnu )?gpl ?{_v(2)}{_LATER}", "general", "gpl"),
    ("gpl-3", f"(?:gnu )?general public {_LIC} {_v(3)}{_LATER}", f"(?:gnu )?gpl ?{_v(3)}{_LATER}", "general", "gpl"),
    ("gpl", f"gnu general public {_LIC}|gnu gpl", f"(?:gnu )?gpl(?: {_LIC})?", "gnu", "gpl"),
    ("lgpl-2", f"(?:gnu )?library general public {_LIC} {_v(2)}{_LATER}", f"(?:gnu )?lgpl ?{_v(2)}{_LATER}", "library", "lgpl"),
    ("lgpl-2.1", f"(?:gnu )?lesser general public {_LIC} {_v(2, 1)}{_LATER}", f"(?:gnu )?lgpl ?{_v(2, 1)}{_LATER}", "lesser", "lgpl"),
    ("lgpl-3", f"(?:gnu )?lesser general public {_LIC} {_v(3)}{_LATER}", f"(?:gnu )?lgpl ?{_v(3)}{_LATER}", "lesser", "lgpl"),
    ("lgpl", f"(?:gnu )?(?:lesser|library) general public {_LIC}", f"(?:gnu )?lgpl(?: {_LIC})?", "lesser|library", "lgpl"),
    ("agpl-3", f"(?:gnu )?affero general public {_LIC} {_v(3)}{_LATER}", f"(?:gnu )?agpl ?{_v(3)}{_LATER}", "affero", "agpl"),
    ("agpl", f"(?:gnu )?affero general public {_LIC}|gnu agpl", f"(?:gnu )?agpl(?: {_LIC})?", "affero|gnu agpl", "agpl"),
    ("gfdl", f"gnu free documentation {_LIC}(?: {_v(1)}(?: [1-3])?)?", f"gfdl(?: {_v(1)}(?: [1-3])?)?", "documentation", "gfdl"),
    ("mpl-1.1", f"mozilla public {_LIC} {_v(1, 1)}", f"mpl ?{_v(1, 1)}", "mozilla", "mpl"),
    ("mpl-2", f"mozilla public {_LIC} {_v(2)}", f"mpl ?{_v(2)}", "mozilla", "mpl"),
    ("mpl", f"mozilla public {_LIC}", f"mpl {_LIC}", "mozilla", "mpl"),
    ("epl-1", f"eclipse public {_LIC} {_v(1)}", f"epl ?{_v(1)}", "eclipse", "epl"),
    ("epl-2", f"eclipse public {_LIC} {_v(2)}", f"epl ?{_v(2)}", "eclipse", "epl"),
    ("epl", f"eclipse public {_LIC}", f"epl {_LIC}", "eclipse", "epl"),
    ("edl-1", f"eclipse distribution {_LIC} {_v(1)}", f"edl ?{_v(1)}", "eclipse", "edl"),
    ("cddl-1", f"common development and distribution {_LIC}(?: {_v(1)})?", f"cddl(?: {_v(1)})?", "development", "cddl"),
    ("cpl-1", f"common public {_LIC}(?: {_v(1)})?", f"cpl ?{_v(1)}", "common", "cpl"),
    ("cpal-1", f"common public attribution {_LIC}(?: {_v(1)})?", f"cpal(?: {_v(1)})?", "attribution", "cpal"),
    ("eupl", f"european union public {_LIC}(?: {_v(1)}(?: [12])?)?", f"eupl(?: {_v(1)}(?: [12])?)?", "european", "eupl"),
    ("artistic-1", f"artistic {_LIC} {_v(1)}", f"artistic {_v(1)}", "artistic", "artistic"),
    ("artistic-2", f"artistic {_LIC} {_v(2)}", f"artistic {_v(2)}", "artistic", "artistic"),
    ("artistic", f"artistic {_LIC}", f"artistic {_LIC}", "artistic", "artistic"),
    ("boost-1", f"boost software {_LIC}(?: {_v(1)})?", f"bsl ?{_v(1)}", "boost", "bsl"),
    ("busl-1.1", f"business source {_LIC}(?: {_v(1, 1)})?", f"busl {_v(1, 1)}", "business", "busl"),
    ("sspl-1", f"server side public {_LIC}(?: {_v(1)})?", f"sspl(?: {_v(1)})?", "server", "sspl"),
    ("elastic-2", f"elastic {_LIC} {_v(2)}", f"elastic {_v(2)}", "elastic", "elastic"),
    ("zlib", f"zlib(?: libpng)? {_LIC}", "zlib", "zlib", "zlib"),
    ("libpng", f"(?:libpng|png reference library) {_LIC}", "libpng(?: 2 0)?", "png", "libpng"),
    ("unlicense", "the unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", f"do what the fuck you want to public {_LIC}", "wtfpl", "fuck", "wtfpl"),
    ("beerware", f"beer ?ware {_LIC}", "beerware", "beer", "beerware"),
    ("postgresql", f"postgresql {_LIC}", "postgresql", "postgresql", "postgresql"),
    ("python-2", f"(?:python software foundation|psf|python) {_LIC}(?: (?:agreement )?{_v(2)})?", f"(?:python|psf) {_v(2)}", "python|psf", "python|psf"),
    ("php-3", f"php {_LIC}(?: {_v(3)}(?: 1)?)?", f"php {_v(3)}(?: 1)?", "php", "php"),
    ("ruby", f"ruby {_LIC}", "ruby", "ruby", "ruby"),
    ("vim", f"vim {_LIC}", "vim", "vim", "vim"),
    ("w3c", f"w3c software(?: notice and| and document)? {_LIC}", "w3c(?: 20150513)?", "w3c", "w3c"),
    ("ncsa", f"university of illinois (?:ncsa )?open source {_LIC}|ncsa open source {_LIC}", "ncsa", "source licen", "ncsa"),
    ("openssl", f"openssl {_LIC}", "openssl", "openssl", "openssl"),
    ("curl", f"curl {_LIC}", "curl", "curl", "curl"),
    ("icu", f"(?:icu|unicode) {_LIC}(?: {_v(3)})?", "icu|unicode (?:3 0|dfs 201[56]|tou)", "icu|unicode", "icu|unicode"),
    ("afl-3", f"academic free {_LIC}(?: {_v(3)})?", f"afl ?{_v(3)}", "academic", "afl"),
    ("osl-3", f"open software {_LIC}(?: {_v(3)})?", f"osl ?{_v(3)}", "software", "osl"),
    ("ecl-2", f"educational community {_LIC}(?: {_v(2)})?", f"ecl ?{_v(2)}", "educational", "ecl"),
    ("ms-pl", f"microsoft public {_LIC}", "ms pl", "microsoft", "ms"),
    ("ms-rl", f"microsoft reciprocal {_LIC}", "ms rl", "microsoft", "ms"),
    ("upl-1", f"universal permissive {_LIC}(?: {_v(1)})?", f"upl ?{_v(1)}", "universal", "upl"),
    ("qpl-1", f"q public {_LIC}(?: {_v(1)})?", f"qpl ?{_v(1)}", "public", "qpl"),
    ("zpl-2", f"zope public {_LIC}(?: {_v(2)}(?: 1)?)?", f"zpl ?{_v(2)}(?: 1)?", "zope", "zpl"),
    ("apsl-2", f"apple public source {_LIC}(?: {_v(2)})?", f"apsl ?{_v(2)}", "apple", "apsl"),
    ("lppl-1", f"latex project public {_LIC}(?: {_v(1)}(?: 3[ac]?)?)?", f"lppl(?: {_v(1)}(?: 3[ac]?)?)?", "latex", "lppl"),
    ("mulan-psl-2", f"mulan (?:psl|permissive software {_LIC}) ?{_v(2)}", f"mulanpsl {_v(2)}", "mulan", "mulanpsl"),
    ("bluoak-1", f"blue oak model {_LIC}(?: {_v(1)})?", f"blueoak {_v(1)}", "blue", "blueoak"),
    ("cecill", f"cecill(?: [abc])?(?: free software)? {_LIC}(?: agreement)?", r"cecill(?: [abc]| 2 [01])?", "cecill", "cecill"),
    ("sleepycat", f"sleepycat {_LIC}", "sleepycat", "sleepycat", "sleepycat"),
    ("ofl-1.1", f"(?:sil )?open font {_LIC}(?: {_v(1, 1)})?", f"ofl(?: {_v(1, 1)})?", "font", "ofl"),
    ("odbl-1", f"open (?:data commons open )?database {_LIC}(?: {_v(1)})?", f"odbl(?: {_v(1)})?", "database", "odbl"),
    ("odc-by-1", f"open data commons attribution {_LIC}(?: {_v(1)})?", f"odc by(?: {_v(1)})?", "commons", "odc"),
    ("pddl-1", f"(?:open data commons )?public domain dedication and {_LIC}(?: {_v(1)})?", f"pddl(?: {_v(1)})?", "dedication", "pddl"),
    ("cdla", f"community data {_LIC} agreement(?: (?:permissive|sharing))?", "cdla (?:permissive|sharing) [12] 0", "community", "cdla"),
    ("openrail", f"(?:creativeml |bigscience )?open ?rail(?: m| s)? {_LIC}", "(?:creativeml |bigscience )?open ?rail(?: m)?", "rail", "rail"),
    ("polyform-nc-1", f"polyform non ?commercial {_LIC}(?: {_v(1)})?", f"polyform non ?commercial {_v(1)}", "polyform", "polyform"),
    ("ogl-3", f"open government {_LIC}(?: {_v(3)})?", f"ogl(?: uk)? {_v(3)}", "government", "ogl"),
    ("cc0-1", "(?:creative commons )?(?:cc0|cc zero|zero)(?: 1 0)?(?: universal)?(?: public domain dedication| licen[cs]e)|creative commons zero",
     "cc0(?: 1 0)?", "cc0|zero", "cc0"),
    _cc("by", _ATTRIBUTION),
    _cc("by sa", f"{_ATTRIBUTION} {_SHARE}"),
    _cc("by nd", f"{_ATTRIBUTION} {_ND}"),
    _cc("by nc", f"{_ATTRIBUTION} {_NC}"),
    _cc("by nc sa", f"{_ATTRIBUTION} {_NC} {_SHARE}"),
    _cc("by nc nd", f"{_ATTRIBUTION} {_NC} {_ND}"),
)

# label, pattern, gates, way
TEXTS: tuple[tuple[str, str, tuple[str, ...], tuple[int, float]], ...] = (
    ("mit", "opensource org licen[cs]es? mit(?: license)?(?: php)?", "opensource mit", ADDRESS),
    ("isc", "opensource org licen[cs]es? isc", "opensource isc", ADDRESS),
    ("bsd-2", "opensource org licen[cs]es? bsd 2 clause", "opensource bsd", ADDRESS),
    ("bsd-3", "opensource org licen[cs]es? bsd 3 clause", "opensource bsd", ADDRESS),
    ("artistic-2", "opensource org licen[cs]es? artistic(?: license)? 2 0", "opensource artistic", ADDRESS),
    ("apache-2", "apache org licen[cs]es license 2 0(?: txt| html)?", "apache", ADDRESS),
    ("gpl-2", "gnu org licen[cs]es (?:old licen[cs]es )?gpl 2 0(?: en)?(?: html| txt)?", "gnu gpl", ADDRESS),
    ("gpl-3", "gnu org licen[cs]es gpl 3 0(?: en)?(?: html| txt)?", "gnu gpl", ADDRESS),
    ("gpl", "gnu org licen[cs]es gpl(?: html| txt)?", "gnu gpl", ADDRESS),
    ("lgpl-2.1", "gnu org licen[cs]es (?:old licen[cs]es )?lgpl 2 1", "gnu lgpl", ADDRESS),
    ("lgpl-3", "gnu org licen[cs]es lgpl 3 0", "gnu lgpl", ADDRESS),
    ("lgpl", "gnu org licen[cs]es lgpl", "gnu lgpl", ADDRESS),
    ("agpl-3", "gnu org licen[cs]es agpl(?: 3 0)?", "gnu agpl", ADDRESS),
    ("gfdl", "gnu org licen[cs]es fdl(?: 1 [1-3])?", "gnu fdl", ADDRESS),
    ("mpl-2", "mozilla org mpl 2 0", "mozilla", ADDRESS),
    ("mpl-1.1", "mozilla org mpl(?: mpl)? 1 1", "mozilla", ADDRESS),
    ("epl-1", "eclipse org legal epl v10(?: html)?", "eclipse epl", ADDRESS),
    ("epl-2", "eclipse org legal epl (?:2 0|v20)", "eclipse epl", ADDRESS),
    ("boost-1", "boost org license 1 0(?: txt)?", "boost", ADDRESS),
    ("unlicense", "unlicense org", "unlicense", ADDRESS),
    ("ofl-1.1", "scripts sil org ofl", "sil", ADDRESS),
    ("odbl-1", "opendatacommons org licen[cs]es odbl", "opendatacommons", ADDRESS),
    ("odc-by-1", "opendatacommons org licen[cs]es by", "opendatacommons", ADDRESS),
    ("pddl-1", "opendatacommons org licen[cs]es pddl", "opendatacommons", ADDRESS),
    ("cc0-1", "creativecommons org publicdomain zero(?: 1 0)?", "creativecommons", ADDRESS),
    ("public-domain", "creativecommons org publicdomain mark(?: 1 0)?", "creativecommons", ADDRESS),
    ("cc-by", "creativecommons org licen[cs]es by(?: [1-4] [05])?", "creativecommons", ADDRESS),
    ("cc-by-sa", "creativecommons org licen[cs]es by sa(?: [1-4] [05])?", "creativecommons", ADDRESS),
    ("cc-by-nd", "creativecommons org licen[cs]es by nd(?: [1-4] [05])?", "creativecommons", ADDRESS),
    ("cc-by-nc", "creativecommons org licen[cs]es by nc(?: [1-4] [05])?", "creativecommons", ADDRESS),
    ("cc-by-nc-sa", "creativecommons org licen[cs]es by nc sa(?: [1-4] [05])?", "creativecommons", ADDRESS),
    ("cc-by-nc-nd", "creativecommons org licen[cs]es by nc nd(?: [1-4] [05])?", "creativecommons", ADDRESS),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby obtaining", SENTENCE),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby fee", SENTENCE),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "binary redistribution", SENTENCE),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions copyright", SENTENCE),
    ("bsd-3", "neither the names? of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software", "neither endorse", SENTENCE),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display", "advertising", SENTENCE),
    ("apache-2", "you may not use this file except in compliance with the license", "compliance licen", SENTENCE),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute gnu", SENTENCE),
    ("gpl", "you should have received a copy of the gnu general public license", "received gnu", SENTENCE),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license", "received gnu", SENTENCE),
    ("agpl", "you should have received a copy of the gnu affero general public license", "received affero", SENTENCE),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v ?2 0", "mozilla", SENTENCE),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "implied liable", SENTENCE),
    ("zlib", "altered source versions must be plainly marked as such", "altered", SENTENCE),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", SENTENCE),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "hereby organization", SENTENCE),
    ("ofl-1.1", "this font software is licensed under the sil open font license", "font", SENTENCE),
    ("wtfpl", "you just do what the fuck you want to", "fuck", SENTENCE),
    ("beerware", "you can buy me a beer in return", "beer", SENTENCE),
    ("public-domain", "(?:released|placed|dedicated) (?:in ?to|in|to) the public domain", "domain", NOTICE),
    ("public-domain", "this (?:work|text|file|document|book) is in the public domain", "domain", NOTICE),
    ("public-domain", "no rights reserved", "reserved", NOTICE),
    ("all-rights-reserved", "all rights reserved", "reserved", GENERAL),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "proprietary", NOTICE),
    ("proprietary", "unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|document|work)", "unauthori", NOTICE),
    ("commercial", "(?:commercial|end user) license agreement", "agreement", TITLE),
    ("non-commercial", "for non ?commercial (?:use|purposes) only", "commercial", NOTICE),
    ("research-only", "for (?:academic|research)(?: and (?:academic|research|educational))? (?:use|purposes) only", "only", NOTICE),
    ("unknown", f"{_UNDER}(?:[^ ]+ ){{0,9}}{_LIC}", "under licen|by licen", GENERAL),
    ("unknown", "see (?:the )?(?:accompanying )?licen[cs]e(?: file)? for (?:details|terms|the full)", "see licen", GENERAL),
)

#: Fixed phrases: they are found everywhere, whatever the rules say.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


def _gates(text: str, *more: str) -> tuple[tuple[str, ...], ...]:
    return tuple((*more, *words.split()) for words in text.split("|"))


def _named() -> list[Rule]:
    out = []
    for label, title, mark, in_title, in_mark in NAMES:
        out.append(Rule(f"tag:{label}", label, f"{_MARK}(?:{mark})", _gates(in_mark, "spdx"), *TAG))
        out.append(Rule(f"notice:{label}", label, f"{_UNDER}(?:{title}|{mark})", _gates(f"{in_title}|{in_mark}"), *NOTICE))
        out.append(Rule(f"title:{label}", label, f"(?:{title})", _gates(in_title), *TITLE))
    return out


RULES: tuple[Rule, ...] = (
    *_named(),
    *(Rule(f"text-{i}:{label}", label, pattern, _gates(gates), *way) for i, (label, pattern, gates, way) in enumerate(TEXTS)),
)

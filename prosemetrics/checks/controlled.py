"""The controlled-language ruleset: 13 checks.

Items of sentence checks are sentences; context["procedure"] says whether the sentence is
in the procedure register. ``vocabulary`` needs a dictionary, a table that the caller gives
as context["dictionary"]; ``operators.vocabulary`` makes it context["vocabulary"], the
verdict on a word. Without one the check has no hits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import all_matches, each, found, group, hit, let, lookup, no_hits, one_if, rx, says
from ..operators.structure import trim, words
from .base import Check, Ruleset

# The word lists, tables and patterns of the controlled-language checks.
MODALS = ("should", "would", "may", "might", "could")
MODAL_DEFAULTS = {"would": "will", "may": "can", "might": "can", "could": "can"}
JARGON = {"leverage": "use", "seamlessly": "", "robustly": "", "effectively": ""}
ING_NOUNS = ("lighting", "opening", "routing", "servicing", "mating", "missing", "remaining", "something", "during")
ING_NEVER_VERBAL = ("thing", "nothing", "anything", "everything", "morning", "evening", "ceiling", "king", "ring", "wing", "spring", "string")
PARTICIPLES = {
    "given": "gave", "written": "wrote", "taken": "took", "done": "did", "gone": "went", "seen": "saw", "known": "knew", "grown": "grew", "shown": "showed", "begun": "began",
    "broken": "broke", "chosen": "chose", "spoken": "spoke", "driven": "drove", "risen": "rose", "fallen": "fell", "forgotten": "forgot", "frozen": "froze", "hidden": "hid", "ridden": "rode",
    "stolen": "stole", "woken": "woke", "torn": "tore", "worn": "wore", "sworn": "swore", "thrown": "threw", "flown": "flew", "drawn": "drew", "blown": "blew", "eaten": "ate",
    "become": "became", "come": "came", "run": "ran", "held": "held", "left": "left", "kept": "kept", "meant": "meant", "found": "found", "sent": "sent", "spent": "spent",
    "built": "built", "made": "made", "paid": "paid", "said": "said", "sold": "sold", "told": "told", "thought": "thought", "brought": "brought", "bought": "bought", "caught": "caught",
    "taught": "taught", "fought": "fought", "sought": "sought", "understood": "understood", "stood": "stood", "won": "won", "sat": "sat", "met": "met", "read": "read", "set": "set",
    "put": "put", "cut": "cut", "shut": "shut", "hit": "hit", "let": "let", "cost": "cost", "hurt": "hurt", "split": "split", "spread": "spread", "burst": "burst",
    "sung": "sang", "swum": "swam", "rung": "rang", "drunk": "drank", "sunk": "sank", "shrunk": "shrank", "slept": "slept", "wept": "wept", "lost": "lost", "led": "led",
    "bent": "bent", "lent": "lent", "bled": "bled", "fed": "fed", "fled": "fled", "bred": "bred", "dealt": "dealt", "felt": "felt", "knelt": "knelt", "smelt": "smelt",
    "spelt": "spelt", "spilt": "spilt", "burnt": "burnt", "learnt": "learnt", "dreamt": "dreamt",
}
BEEN = {"has": "was", "have": "were", "had": "was"}
PROGRESSIVE_PAST = {
    "running": "ran", "going": "went", "writing": "wrote", "reading": "read", "sending": "sent", "receiving": "received", "throwing": "threw", "catching": "caught", "building": "built",
    "checking": "checked", "trying": "tried", "waiting": "waited", "starting": "started", "stopping": "stopped", "failing": "failed", "loading": "loaded", "processing": "processed",
    "connecting": "connected", "closing": "closed", "opening": "opened", "testing": "tested", "deploying": "deployed", "restarting": "restarted", "updating": "updated", "installing": "installed",
    "configuring": "configured", "syncing": "synced", "retrying": "retried", "logging": "logged", "monitoring": "monitored", "queuing": "queued", "scaling": "scaled", "restoring": "restored",
    "validating": "validated", "verifying": "verified", "creating": "created", "deleting": "deleted", "uploading": "uploaded", "downloading": "downloaded", "compiling": "compiled",
    "executing": "executed", "returning": "returned", "handling": "handled", "blocking": "blocked", "polling": "polled", "timing": "timed", "backing": "backed", "working": "worked", "saving": "saved",
}
CONTRACTIONS = {
    "don't": "do not", "doesn't": "does not", "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not", "can't": "cannot", "won't": "will not",
    "shouldn't": "should not", "wouldn't": "would not", "couldn't": "could not", "didn't": "did not", "hasn't": "has not", "haven't": "have not", "hadn't": "had not", "mustn't": "must not",
    "i'm": "I am", "i've": "I have", "i'll": "I will", "i'd": "I would", "you're": "you are", "you've": "you have", "you'll": "you will", "you'd": "you would",
    "we're": "we are", "we've": "we have", "we'll": "we will", "we'd": "we would", "they're": "they are", "they've": "they have", "they'll": "they will", "they'd": "they would",
    "it's": "it is", "that's": "that is", "there's": "there is", "here's": "here is", "what's": "what is", "who's": "who is", "let's": "let us", "she's": "she is", "he's": "he is",
}
LATIN = {"e.g.": "for example", "i.e.": "that is", "etc.": "and more", "et al.": "and others", "vs.": "versus", "cf.": "compare", "n.b.": "note", "viz.": "namely"}
PRONOUNS = ("he", "him", "his", "she", "her", "hers", "himself", "herself")
TERMS = ("man", "woman", "men", "women")
ROTATIONS = (("check-verify", r"\b(check|verify|confirm|validate|ensure)\w*\b"), ("config-settings", r"\b(config|configuration|settings|options)\b"), ("delete-remove", r"\b(delete|remove|drop|destroy)\w*\b"), ("run-execute", r"\b(run|execute|invoke|launch)\w*\b"), ("show-display", r"\b(show|display|render|present)\w*\b"))
SAFETY_LABEL = r"^\**(WARNING|CAUTION|DANGER|NOTICE|ATTENTION)\**\s*:?\s*"
CONSEQUENCE = r"\b(can|will|may)\s+\w*\s*(cause|result|occur|damage|injure|injury|death)\b|\b(causes?|results?\s+in|leads?\s+to)\b"
WEAK_STARTS = ("but", "and", "so", "however", "this", "it", "there")
IRREGULAR_BASES = {"is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "am": "be", "being": "be", "does": "do", "did": "do", "done": "do", "doing": "do", "has": "have", "had": "have", "having": "have", "goes": "go", "went": "go", "gone": "go", "going": "go"}
LIMITS = {"procedure_word_limit": 20, "description_word_limit": 25}

LATIN_PATTERN = r"\b(" + "|".join(re.escape(k) for k in sorted(LATIN, key=len, reverse=True)) + ")"
PERFECT = r"\b(has|have|had)\s+(?!been\b)(\w+)\b"
MODAL = r"\b(should|would|may|might|could)\b"
COLLOCATION = r"(?=\s+(?:need|want|have|wish|like)\s+to\b)"
PROGRESSIVE = r"\b(is|are|was|were)\s+(\w+ing)\b"
PASSIVE = r"\b(is|are|was|were|be|been|being)\s+(\w+ed)\b"
#: From the first word character of a stretch without a full stop: any later one would match no more, and this is linear.
TRAILING = r"(?:^|[.!?\n])[^\w.!?\n]*\w[^.!?\n]{3,}?\s(if|when)\b\s"


def _join(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" "), b)


def _zipped(s: Column, pattern: str, of, first: int = 1, second: int = 2) -> Column:
    """Hits of of(group, group) over all matches; null ones are dropped. Most sentences have none, which takes one search."""
    some = F.filter(F.zip_with(all_matches(s, pattern, True, first), all_matches(s, pattern, True, second), of), lambda h: h.isNotNull())
    return F.when(found(s, pattern, True), some).otherwise(no_hits())


def safety_instruction(block: Column, _: dict) -> Column:
    def of(t: Column) -> Column:
        label = F.upper(group(t, SAFETY_LABEL, 1, True))

        def judge(body: Column) -> Column:
            first = F.regexp_replace(F.lower(F.regexp_extract(body, rx(r"^(\S+)"), 1)), r"^[.,;:]+|[.,;:]+$", "")
            start = one_if(first.isin(*WEAK_STARTS), hit(label, "7.2", note=F.concat(F.lit("starts with "), first)))
            silent = one_if(~found(body, CONSEQUENCE, True), hit(label, "7.3", note="no consequence stated"))
            full = F.concat(start, silent)
            return F.when(~found(t, SAFETY_LABEL, True), no_hits()).when(body == "", F.array(hit(label, "7.2", note="no instruction"))).otherwise(full)

        return let(trim(F.regexp_replace(t, rx(SAFETY_LABEL, True), "")), judge)

    return let(trim(block), of)


def length(s: Column, context: dict) -> Column:
    limits = LIMITS | context.get("limits", {})
    limit = F.when(context.get("procedure", F.lit(False)), limits["procedure_word_limit"]).otherwise(limits["description_word_limit"])
    n = F.regexp_count(s, F.lit(rx(r"\S+")))
    return one_if(n > limit, hit(rule="5.1", note=F.concat(n.cast("string"), F.lit(" words, limit "), limit.cast("string"))))


def vocabulary(s: Column, context: dict) -> Column:
    """Words that the dictionary does not allow; none without a dictionary."""
    verdict = context.get("vocabulary")
    if verdict is None:
        return no_hits()

    def of(w: Column) -> Column:
        rule = lambda v: F.when(v["type"] == "unknown_vocabulary", "1.5").otherwise("1.1")
        flagged = lambda v: F.when(v.isNotNull(), hit(w, rule(v), v["type"], False, v["replacement"]))
        return let(verdict(F.btrim(F.lower(w), F.lit("'"))), flagged)

    return F.filter(F.transform(words(s), of), lambda h: h.isNotNull())


def vocabulary_labels(some: Column, context: dict) -> Column:
    """The words of all sentences that :func:`vocabulary` flags, each once: most have no more to tell than that."""
    verdict = context.get("vocabulary")
    if verdict is None:
        return F.array().cast("array<string>")
    tokens = F.array_distinct(F.transform(words(F.array_join(some, " ")), F.lower))
    return F.filter(tokens, lambda w: verdict(F.btrim(w, F.lit("'"))).isNotNull())


def ing_form(s: Column, _: dict) -> Column:
    some = F.filter(all_matches(s, r"\b(\w+ing)\b", True, 1), lambda w: ~F.lower(w).isin(*ING_NOUNS, *ING_NEVER_VERBAL))
    return F.when(found(s, r"ing\b", True), each(some, rule="3.5", auto_fix=None, note="not among the words that may end so")).otherwise(no_hits())


def perfect_tense(s: Column, _: dict) -> Column:
    been = F.transform(all_matches(s, r"\b(has|have|had)\s+been\b", True, 1), lambda a: hit(_join(a, F.lit("been")), "3.4", auto_fix=True, replacement=lookup(BEEN, F.lower(a))))

    def of(a: Column, b: Column) -> Column:
        past = F.when(F.endswith(F.lower(b), F.lit("ed")), b).otherwise(lookup(PARTICIPLES, F.lower(b)))
        return F.when(past.isNotNull(), hit(_join(a, b), "3.4", auto_fix=True, replacement=past))

    return F.when(found(s, r"\b(has|have|had)\s", True), F.concat(been, _zipped(s, PERFECT, of))).otherwise(no_hits())


def progressive(s: Column, _: dict) -> Column:
    def of(a: Column, b: Column) -> Column:
        past = F.when(F.lower(a).isin("was", "were"), lookup(PROGRESSIVE_PAST, F.lower(b)))
        return hit(_join(a, b), "3.2", auto_fix=past.isNotNull(), replacement=past, note=F.when(past.isNull(), "needs agreement or is not in the table"))

    return _zipped(s, PROGRESSIVE, of)


def passive(s: Column, _: dict) -> Column:
    return _zipped(s, PASSIVE, lambda a, b: hit(_join(a, b), "3.6", note="name the actor"))


def modal(s: Column, _: dict) -> Column:
    """A modal before need/want/have/wish/like to is matched with what follows, so its place need not be known."""
    has_if, warned = found(s, r"\bif\b", True), found(s, r"\b(warning|caution)\b", True)
    some = F.regexp_extract_all(s, F.lit(rx(r"\b(?:should|would|may|might|could)\b(?:\s+(?:need|want|have|wish|like)\s+to\b)?", True)), F.lit(0))

    def of(m: Column) -> Column:
        word = F.lower(F.regexp_extract(m, rx(r"^(\w+)"), 1))
        fixed = (word != "should") & ~found(m, r"\s")
        to = F.when(~fixed, None).when(has_if, "can").when(warned, "must").otherwise(lookup(MODAL_DEFAULTS, word))
        rule = F.when(word == "should", "10.6").when(~fixed, "5.3/13.3").otherwise("5.3")
        note = F.when(~fixed, "needs a rewrite").when(has_if, "if clause").when(warned, "warning").otherwise("default")
        return hit(word, rule, auto_fix=fixed, replacement=to, note=note)

    return F.transform(some, of)


def punctuation(s: Column, _: dict) -> Column:
    semicolon = one_if(F.contains(s, F.lit(";")), hit(rule="8.1", kind="semicolon", auto_fix=True))
    short = F.filter(all_matches(s, r"\b\w+'\w+\b"), lambda w: lookup(CONTRACTIONS, F.lower(w)).isNotNull())
    return F.concat(semicolon, F.transform(short, lambda w: hit(w, "8.2", "contraction", True, lookup(CONTRACTIONS, F.lower(w)))))


def trailing_condition(s: Column, _: dict) -> Column:
    return one_if(found(s, TRAILING, True) & ~found(s, r"^(if|when)\b", True), hit(rule="5.4", note="put the condition first"))


def latin_abbrev(s: Column, _: dict) -> Column:
    return F.transform(all_matches(s, LATIN_PATTERN, True, 1), lambda w: hit(w, "GR-6", auto_fix=True, replacement=lookup(LATIN, F.lower(w))))


def inclusive_language(s: Column, _: dict) -> Column:
    some = F.filter(words(s), lambda w: F.lower(w).isin(*PRONOUNS, *TERMS))
    return F.transform(some, lambda w: hit(w, "GR-7", F.when(F.lower(w).isin(*PRONOUNS), "pronoun").otherwise("term"), note="name the actor"))


def synonym_rotation(text: Column, _: dict) -> Column:
    def of(name: str, pattern: str) -> Column:
        stems = F.array_sort(F.array_distinct(F.transform(all_matches(text, pattern, True, 1), lambda w: F.regexp_replace(F.lower(w), "s+$", ""))))
        # Joined terms are the flag's note; a flag of this kind has no label of its own.
        return let(stems, lambda x: one_if(F.size(x) > 1, hit(rule="1.11", kind=name, note=F.array_join(x, ", "))))

    return F.concat(*[of(n, p) for n, p in ROTATIONS])


#: Literals, one of which stands in whatever each check can flag.
_SAYS = {
    "ing_form": ("ing",), "perfect_tense": ("has", "have", "had"), "progressive": ("ing",), "passive": ("ed",), "modal": MODALS, "punctuation": (";", "'"),
    "trailing_condition": ("if", "when"), "latin_abbrev": tuple(LATIN),
    "synonym_rotation": tuple(w for _, p in ROTATIONS for w in re.findall(r"[a-z]{2,}", p)),
}


def _c(find, unit="SENTENCE", action="block", **more) -> Check:
    name = find.__name__
    return Check(name, unit, find, action=action, likely=says(*_SAYS[name]) if name in _SAYS else None, **more)


def _fixable(h: Column) -> Column:
    return F.coalesce(h["auto_fix"], F.lit(False))


RULESET = Ruleset(
    "controlled",
    (
        _c(safety_instruction, "BLOCK"), _c(length, params=LIMITS), _c(vocabulary, action="warn", bucket=_fixable, labels=vocabulary_labels), _c(ing_form), _c(perfect_tense, bucket="mechanical"),
        _c(progressive, bucket=_fixable), _c(passive), _c(modal, bucket=lambda h: _fixable(h) & (F.coalesce(h["replacement"], F.lit("")) != "")), _c(punctuation, bucket="mechanical"),
        _c(trailing_condition), _c(latin_abbrev, bucket="mechanical"), _c(inclusive_language), _c(synonym_rotation, "DOCUMENT"),
    ),
    whole="sentences",
    keep_apart=frozenset({"length", "trailing_condition", "synonym_rotation", "safety_instruction"}),
)

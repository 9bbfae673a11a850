"""The prose ruleset: 31 checks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import all_matches, any_of, count_matches, each, first_match, found, group, hit, let, no_hits, one_if, rx, says
from ..operators.structure import trim
from .base import Check, Ruleset

# The word lists and patterns of the prose checks.
FILLER_OPENERS = (r"it(?:'s| is) (?:worth noting|important to note) that\b", r"needless to say\b", r"at the end of the day\b", r"when all is said and done\b", r"in (?:today's|this) (?:fast-paced|rapidly evolving|ever-changing)\b")
STOCK_ADVERBS = ("undoubtedly", "arguably", "notably", "importantly", "ultimately")
COLON_LABELS = ("note", "example", "examples", "warning", "caution", "steps", "requirement", "requirements", "following", "summary", "tip", "important", "needed", "required", "include", "includes", "contains", "options", "source", "date", "incident", "help", "legend", "given")
WEASEL_PHRASES = ("studies show", "experts agree", "research suggests", "many believe")
MARKETING_ADJECTIVES = ("seamless", "robust", "powerful", "cutting-edge", "comprehensive", "vibrant", "elegant", "intuitive", "game-changing")
FILLER_VERBS = ("surfaces", "leverages?", "enables?", "powers", "facilitates?", "utili[sz]es?", "fosters?", "drives", "unlocks?", "delivers?", "streamlines?", "empowers?", "showcases?")
MARKETING_CLICHES = ("amazing", "breathtaking", "stunning", "must-visit", "must visit", "must-see", "must see", "perfect for everyone", "hidden gem", "top destination", "ultimate guide", "complete guide", "world-class", "world class", "in this article we will", "in this guide we will", "let's dive in", "without further ado", "look no further", "you've come to the right place", "we've got you covered")
COPULA_DODGES = ("serves as", "stands as", "functions as", "acts as", "boasts", "features a", "marks a", "represents a", "emerged as", "positioned as")
SECTION_TEMPLATES = ("despite its success", "despite these challenges", "challenges and future", "future prospects", "in conclusion", "looking ahead", "the road ahead", "key takeaways", "final thoughts", "in summary")
VAGUE_INTENSIFIERS = ("very", "really", "quite", "significantly")
TAIL_PARTICIPLES = ("highlighting", "underscoring", "emphasizing", "showcasing", "reflecting", "demonstrating", "illustrating", "signaling", "marking", "ensuring", "allowing", "enabling", "providing", "offering", "making it", "solidifying", "cementing")
SOLICITATIONS = (r"\broast it\b", r"\btell me what\W*s wrong\b", r"\bhappy to hear what\W*s off\b", r"\blet me know how it could be improved\b", r"\bwould love your feedback on this\b")
PROFUNDITIES = ("something shifted", "everything changed", "nothing would ever be the same", "but here's the thing", "and then it hit me")
FRAGMENTS = ("that's it", "that's the whole thing", "that's the whole point", "that's the whole story", "full stop", "simple as that")
SMALL_WORDS = ("a", "an", "the", "and", "or", "but", "for", "of", "in", "on", "to", "with", "at", "by", "from", "as", "is", "it")
EM_DASH_ENTITY = r"&mdash;|&#0*8212;|&#[xX]0*2014;"
SECTION_ENTITY = r"&sect;|&#0*167;|&#[xX]0*[aA]7;"
MIDDOT_ENTITY = r"&middot;|&centerdot;|&CenterDot;|&bull;|&bullet;|&#0*183;|&#0*8226;|&#[xX]0*[bB]7;|&#[xX]0*2022;"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}]"
REMNANTS = r"oaicite|\[cite:\s*\d+\]|grok_card|contentReference|as an ai language model|i cannot browse|my knowledge cutoff|as of my last update|\[INSERT [A-Z ]+\]|\bTODO: (?:fill|add) (?:in|the)\b"
NUMBERED_LABEL = r"^[A-Za-z]+\s+(?:\d+(?:\.\d+)*|one|two|three|four|five|six|seven|eight|nine|ten)$"
IDENTIFIER = r"\b_{0,2}[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+_{0,2}\b"
MARKER = r"\s*(?:[-*+]|\d+\.)\s+"

UNIFORM_BELOW, LONG_PARAGRAPH, PARAGRAPHS = 0.35, 20, 4


def _rule(name: str) -> str:
    return f"prose.{name}"


def _extra(context: dict, check: str) -> tuple:
    return tuple(context.get("extra", {}).get(check, ()))


def filler_opener(s: Column, _: dict) -> Column:
    t = trim(s)
    phrase = F.coalesce(*[first_match(t, "^" + p, True) for p in FILLER_OPENERS])
    return one_if(phrase.isNotNull(), hit(phrase, _rule("filler_opener"), note="cut the opener and state the point"))


def adverb_pattern(extra=()) -> str:
    return r"(,\s*)?" + any_of((*STOCK_ADVERBS, *extra)) + r"(,\s*|\s+)?"


def stock_adverb(s: Column, context: dict) -> Column:
    return each(all_matches(s, adverb_pattern(_extra(context, "stock_adverb")), True, 2), rule=_rule("stock_adverb"), auto_fix=True, replacement="")


def colon_reveal(s: Column, _: dict) -> Column:
    reveal = r"^(.{1,60}?):\s+(\S.*)$"

    def judge(t: Column) -> Column:
        def of(before: Column) -> Column:
            n = F.regexp_count(before, F.lit(rx(r"\S+")))
            last = F.regexp_replace(F.lower(F.regexp_extract(before, rx(r"(\S+)\s*$"), 1)), r"^[.,;:]+|[.,;:]+$", "")
            bold = F.regexp_replace(before, r"^[-—•\t ]+", "").startswith("**")
            ok = found(t, reveal) & ~bold & ~found(before, NUMBERED_LABEL, True) & n.between(1, 6) & ~last.isin(*COLON_LABELS)
            return one_if(ok, hit(F.concat(before, F.lit(":")), _rule("colon_reveal"), note="say it in one plain sentence"))

        return let(trim(group(t, reveal, 1)), of)

    return let(trim(s), judge)


def _pairs(items: Column, of) -> Column:
    """Hits of of(a, b) over neighbours."""

    def run(xs: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.size(xs) - 2), lambda i: of(F.get(xs, i), F.get(xs, i + 1)))
        return F.when(F.size(xs) > 1, F.flatten(some)).otherwise(no_hits())

    return let(F.transform(items, trim), run)


IS_OPENER = r"^(it'?s|it is|this is|that is)"


def binary_contrast(items: Column, _: dict) -> Column:
    def of(a: Column, b: Column) -> Column:
        ok = found(a, IS_OPENER + r" not\b", True) & found(b, IS_OPENER + r"\b", True) & ~found(b, r"\bnot\b", True)
        return one_if(ok, hit(a, _rule("binary_contrast"), note="state the second half", text=F.concat_ws(" ", a, b)))

    return _pairs(items, of)


def canned_question_answer(items: Column, _: dict) -> Column:
    def of(a: Column, b: Column) -> Column:
        ok = found(a, r"^\S+(?:\s+\S+){0,4}\?$") & found(b, r"^(it|this|the|that|why|because)\b", True)
        return one_if(ok, hit(a, _rule("canned_question_answer"), note="make it one statement", text=F.concat_ws(" ", a, b)))

    return _pairs(items, of)


def negative_listing(items: Column, _: dict) -> Column:
    """Pairs within a run of sentences that open with ``not``: every second sentence of the run closes one."""

    def run(xs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("ends"))

        def step(acc, x):
            n = F.when(found(x, r"^not\b", True), acc["run"] + 1).otherwise(0)
            ends = F.when((n > 0) & (n % 2 == 0), F.concat(acc["ends"], F.array(acc["i"]))).otherwise(acc["ends"])
            return F.struct(n.alias("run"), (acc["i"] + 1).alias("i"), ends.alias("ends"))

        ends = F.aggregate(xs, zero, step, lambda a: a["ends"])
        pair = lambda i: hit(F.get(xs, i - 1), _rule("negative_listing"), note="state the point once", text=F.concat_ws(" ", F.get(xs, i - 1), F.get(xs, i)))
        return F.transform(ends, pair)

    return let(F.transform(items, trim), run)


def rule_of_three(s: Column, _: dict) -> Column:
    m = first_match(s, r"\b(\w+ing)\b,\s+(\w+ing)\b,?\s+and\s+(\w+ing)\b", True)
    return one_if(m.isNotNull(), hit(F.substring(m, 1, 60), _rule("rule_of_three"), note="keep the item that says something"))


def _first_listed(phrases, test) -> Column:
    """The first phrase, in order, for which test holds; null if none."""
    return F.coalesce(*[F.when(test(p), F.lit(p)) for p in phrases])


def copula_avoidance(s: Column, context: dict) -> Column:
    p = _first_listed((*COPULA_DODGES, *_extra(context, "copula_avoidance")), lambda p: F.contains(F.lower(s), F.lit(p)))
    return one_if(p.isNotNull(), hit(p, _rule("copula_avoidance"), note="use the plain verb"))


def participial_tail(s: Column, _: dict) -> Column:
    m = first_match(s, r",\s+(" + "|".join(TAIL_PARTICIPLES) + r")\b", True)
    return one_if(m.isNotNull(), hit(F.substring(trim(m), 1, 50), _rule("participial_tail"), note="drop the clause or make it a claim"))


def section_template(s: Column, context: dict) -> Column:
    low = F.regexp_replace(F.lower(s), r"^[#* -]+", "")
    p = _first_listed((*SECTION_TEMPLATES, *_extra(context, "section_template")), lambda p: F.startswith(low, F.lit(p)) | F.contains(low, F.lit(" " + p)))
    return one_if(p.isNotNull(), hit(p, _rule("section_template"), note="say what the section is for"))


def _counted(n: Column, name: str, note: str) -> Column:
    return one_if(n > 0, hit(rule=_rule(name), occurrences=n, note=F.concat(n.cast("string"), F.lit(note))))


def bold_density(text: Column, _: dict) -> Column:
    body = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~found(x, r"^\s*\|.*\|\s*$")), "\n")
    return _counted(count_matches(body, r"\*\*[^*\n]{1,80}\*\*"), "bold_density", " bold spans")


def thematic_break(text: Column, _: dict) -> Column:
    body = F.regexp_replace(text, r"\A---(?s:.*?)\n---", "")
    return _counted(count_matches(body, r"(?m)^\s*(?:---+|\*\*\*+|___+)\s*$"), "thematic_break", " rules")


def title_case_heading(text: Column, _: dict) -> Column:
    headings = all_matches(text, r"(?m)^(#{1,6})\s+(.+?)\s*$", group=2)

    def titled(h: Column) -> Column:
        def of(w: Column) -> Column:
            rest = F.filter(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x: ~F.lower(x).isin(*SMALL_WORDS))
            capital = lambda x: (F.substring(x, 1, 1) != F.lower(F.substring(x, 1, 1))) & ~(F.upper(x) == x)
            return let(rest, lambda r: (F.size(w) >= 3) & (F.size(r) >= 2) & F.forall(r, capital))

        return let(all_matches(h, r"[A-Za-z][\w'-]*"), of)

    first = F.get(F.filter(headings, titled), F.lit(0))
    return one_if(first.isNotNull(), hit(F.substring(first, 1, 60), _rule("title_case_heading"), note="use sentence case"))


def ai_markup_remnant(text: Column, _: dict) -> Column:
    m = first_match(text, REMNANTS, True)
    return one_if(m.isNotNull(), hit(F.substring(m, 1, 50), _rule("ai_markup_remnant"), note="left over from the generator"))


def paragraph_uniformity(text: Column, _: dict) -> Column:
    paras = F.filter(F.transform(F.split(text, rx(r"\n\s*\n"), -1), trim), lambda p: (p != "") & ~p.rlike(r"^(?:[#*>|-]|```)"))
    sizes = F.filter(F.transform(paras, lambda p: F.regexp_count(p, F.lit(rx(r"\S+")))), lambda n: n >= LONG_PARAGRAPH)

    def spread(xs: Column) -> Column:
        n = F.size(xs).cast("double")
        mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0.0))
        squares = let(mean, lambda m: F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
        ratio = F.sqrt(squares / F.nullif(n - 1, F.lit(0.0))) / F.nullif(mean, F.lit(0.0))
        few = F.size(xs) >= PARAGRAPHS
        label = F.concat(F.size(xs).cast("string"), F.lit(" paragraphs, spread "), F.format_string("%.2f", ratio))
        return one_if(few & (ratio < UNIFORM_BELOW), hit(label, _rule("paragraph_uniformity"), note="vary the paragraphs"))

    return let(sizes, spread)


def em_dash_cluster(text: Column, _: dict) -> Column:
    return _counted(count_matches(text, "—|" + EM_DASH_ENTITY), "em_dash_cluster", " em dashes")


def weasel_attribution(s: Column, context: dict) -> Column:
    return each(all_matches(s, _listed(WEASEL_PHRASES, _extra(context, "weasel_attribution")), True, 1), rule=_rule("weasel_attribution"), note="name the source")


def _listed(phrases, extra=()) -> str:
    """In the order given: the first alternative that matches wins."""
    return r"\b(" + "|".join(re.escape(p) for p in (*phrases, *extra)) + r")\b"


def entity_encoded_punctuation(s: Column, _: dict) -> Column:
    kinds = ((EM_DASH_ENTITY, "write the dash itself"), (SECTION_ENTITY, "write the word section"), (MIDDOT_ENTITY, "join with commas"))
    return F.concat(*[each(all_matches(s, p), rule=_rule("entity_encoded_punctuation"), auto_fix=True, note=n) for p, n in kinds])


def bold_bullet_lead(line: Column, _: dict) -> Column:
    p = rf"^({MARKER})(\*\*|__)(.+?)\2(.*)$"
    bold = group(line, p, 3)
    ok = found(line, p) & ~bold.rlike(r"[.:?!]$") & found(group(line, p, 4), r"\S")
    return one_if(ok, hit(bold, _rule("bold_bullet_lead"), note="keep bold for rare callouts"))


def id_label_lead(line: Column, _: dict) -> Column:
    p = r"^(\s*(?:[-*+]|\d+[.)])\s+)(\*\*|__)?([A-Z]{1,4}-?\d{1,2}(?:\.\d{1,2})?)(.*)$"
    bold, rest = F.coalesce(group(line, p, 2), F.lit("")), group(line, p, 4)
    closed = (bold == "") | F.startswith(rest, bold)
    tail = F.when(bold == "", rest).otherwise(F.substring(rest, 3, 1 << 20))
    ok = found(line, p) & closed & found(tail, "^[:).]?\\s+(?:[-–—]\\s*)?[*_\"']?[A-Z]")
    return one_if(ok, hit(group(line, p, 3), _rule("id_label_lead"), note="number the list plainly"))


def not_just_x_but_y(s: Column, _: dict) -> Column:
    m = first_match(s, r"\bnot just\b[^.?!]{0,60}?\bbut\b", True)
    return one_if(m.isNotNull(), hit(m, _rule("not_just_x_but_y"), note="make the point once"))


def vague_intensifier(s: Column, _: dict) -> Column:
    return each(all_matches(s, any_of(VAGUE_INTENSIFIERS), True, 1), rule=_rule("vague_intensifier"), note="say how much")


def emoji_in_prose(s: Column, _: dict) -> Column:
    return each(all_matches(s, EMOJI), rule=_rule("emoji_in_prose"), auto_fix=True, note="decoration in body text")


def marketing_adjective(s: Column, context: dict) -> Column:
    return each(all_matches(s, any_of((*MARKETING_ADJECTIVES, *_extra(context, "marketing_adjective"))), True, 1), rule=_rule("marketing_adjective"), note="say what is true instead")


def filler_verb(s: Column, context: dict) -> Column:
    plain = r"\b(" + "|".join((*FILLER_VERBS, *map(re.escape, _extra(context, "filler_verb")))) + r")\b"
    return each(F.concat(all_matches(s, plain, True, 1), all_matches(s, r"\bdelves?\b(?=\s+(?:into|deeper))", True)), rule=_rule("filler_verb"), note="use a plain verb")


def marketing_cliche(s: Column, context: dict) -> Column:
    return each(all_matches(s, _listed(MARKETING_CLICHES, _extra(context, "marketing_cliche")), True, 1), rule=_rule("marketing_cliche"), note="say the specific thing")


def solicit_criticism(s: Column, _: dict) -> Column:
    some = F.array_compact(F.array(*[first_match(s, p, True) for p in SOLICITATIONS]))
    return each(some, rule=_rule("solicit_criticism"), note="cut it")


def _whole(phrases) -> str:
    return "^(?:" + "|".join(map(re.escape, phrases)) + r")\.?$"


def unearned_profundity(s: Column, _: dict) -> Column:
    return one_if(found(trim(s), _whole(PROFUNDITIES), True), hit(trim(s), _rule("unearned_profundity"), note="name the event"))


def dramatic_fragmentation(s: Column, _: dict) -> Column:
    return one_if(found(trim(s), _whole(FRAGMENTS), True), hit(trim(s), _rule("dramatic_fragmentation"), note="cut it"))


def terminology(s: Column, context: dict) -> Column:
    """context["lexicon"]: banned term to note."""
    lexicon = {k.lower(): v for k, v in context.get("lexicon", {}).items()}
    if not lexicon:
        return no_hits()
    notes = F.create_map(*[F.lit(x) for pair in lexicon.items() for x in pair])
    return each(all_matches(s, any_of(lexicon), True, 1), rule=_rule("terminology"), note=lambda w: F.coalesce(F.nullif(F.try_element_at(notes, F.lower(w)), F.lit("")), F.lit("one word, one meaning")))


def identifier_in_prose(s: Column, _: dict) -> Column:
    return each(all_matches(s, IDENTIFIER), rule=_rule("identifier_in_prose"), note="name it in words or mark it as code")


# What a document must say for a check to have a hit, as literals in lower case.
LIKELY = {
    "filler_opener": says("worth noting that", "important to note that", "needless to say", "at the end of the day", "when all is said and done", "fast-paced", "rapidly evolving", "ever-changing", begins=True),
    "stock_adverb": says(*STOCK_ADVERBS, terms="stock_adverb", begins=True), "colon_reveal": says(":"), "binary_contrast": says("s not"), "rule_of_three": says("ing,"),
    "copula_avoidance": says(*COPULA_DODGES, terms="copula_avoidance"), "participial_tail": says(*TAIL_PARTICIPLES, begins=True),
    "section_template": says(*SECTION_TEMPLATES, terms="section_template", begins=True), "weasel_attribution": says(*WEASEL_PHRASES, terms="weasel_attribution", begins=True),
    "entity_encoded_punctuation": says("&"), "not_just_x_but_y": says("not just", begins=True), "vague_intensifier": says(*VAGUE_INTENSIFIERS, begins=True),
    "emoji_in_prose": lambda t, _: (F.octet_length(t) > F.char_length(t)) & found(t, EMOJI), "marketing_adjective": says(*MARKETING_ADJECTIVES, terms="marketing_adjective", begins=True),
    "filler_verb": says(*(re.split(r"e?s\?|\[", v)[0] if v.endswith("?") else v for v in FILLER_VERBS), "delve", terms="filler_verb", begins=True),
    "marketing_cliche": says(*MARKETING_CLICHES, terms="marketing_cliche", begins=True),
    "solicit_criticism": says("roast it", "tell me what", "happy to hear what", "let me know how", "would love your feedback", begins=True),
    "unearned_profundity": says(*PROFUNDITIES, begins=True), "dramatic_fragmentation": says(*FRAGMENTS, begins=True), "canned_question_answer": says("?"),
    "bold_density": says("**"), "thematic_break": says("---", "***", "___"), "title_case_heading": says("#"), "paragraph_uniformity": says("\n"),
    "ai_markup_remnant": says("oaicite", "[cite:", "grok_card", "contentreference", "as an ai language model", "i cannot browse", "my knowledge cutoff", "as of my last update", "[insert ", "todo: "),
    "em_dash_cluster": lambda t, _: F.contains(t, F.lit("—")) | F.contains(t, F.lit("&")), "negative_listing": says("\nnot"), "terminology": lambda t, context: says(*context.get("lexicon", {}))(t, {}), "identifier_in_prose": says("_"),
}


def _c(find, unit="SENTENCE", **more) -> Check:
    return Check(find.__name__, unit, find, likely=LIKELY.get(find.__name__), **more)


RULESET = Ruleset(
    "prose",
    (
        _c(filler_opener), _c(stock_adverb, bucket="mechanical", terms_list="stock_adverb"), _c(colon_reveal), _c(binary_contrast, "SENTENCES"),
        _c(rule_of_three), _c(copula_avoidance, terms_list="copula_avoidance"), _c(participial_tail), _c(section_template, terms_list="section_template"),
        _c(bold_density, "DOCUMENT", threshold=8), _c(thematic_break, "DOCUMENT", threshold=2), _c(title_case_heading, "DOCUMENT"),
        _c(ai_markup_remnant, "DOCUMENT", kind="defect"), _c(paragraph_uniformity, "DOCUMENT"), _c(em_dash_cluster, "DOCUMENT", threshold=4),
        _c(weasel_attribution, terms_list="weasel_attribution"), _c(entity_encoded_punctuation, kind="defect", bucket="mechanical"),
        _c(bold_bullet_lead, "LINE"), _c(id_label_lead, "LINE", kind="defect"), _c(not_just_x_but_y), _c(vague_intensifier),
        _c(emoji_in_prose, kind="defect", bucket="mechanical"), _c(marketing_adjective, terms_list="marketing_adjective"), _c(filler_verb, terms_list="filler_verb"),
        _c(marketing_cliche, terms_list="marketing_cliche"), _c(solicit_criticism), _c(unearned_profundity), _c(dramatic_fragmentation),
        _c(canned_question_answer, "SENTENCES"), _c(negative_listing, "SENTENCES"), _c(terminology, terms_list="terminology"), _c(identifier_in_prose),
    ),
    keep_apart=frozenset({"em_dash_cluster"}),
)

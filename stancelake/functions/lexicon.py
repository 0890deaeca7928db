"""Modality markers and process verbs as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers by band, negators, and verb lists by process.
BANDS = {
    "low": ("might", "may", "could", "perhaps", "maybe", "possibly", "i think", "it seems", "i guess", "i suppose"),
    "median": ("probably", "likely", "should", "would", "i believe"),
    "high": ("must", "certainly", "definitely", "clearly", "always", "never", "of course", "no doubt"),
}
NEGATORS = ("not", "no", "cannot")
WINDOW = 2
FLIP = {"low": "high", "high": "low", "median": "median"}
VERBS = {
    "mental": ("think", "know", "believe", "understand", "feel", "see", "hear", "want", "need", "like", "love", "hate", "consider", "suppose", "expect", "remember", "forget", "imagine", "notice", "realize"),
    "relational": ("be", "seem", "become", "appear", "remain", "stay", "look", "sound", "taste", "smell", "feel"),
    "verbal": ("say", "tell", "speak", "talk", "ask", "answer", "reply", "respond", "declare", "announce", "report", "explain", "suggest", "propose"),
    "behavioral": ("breathe", "smile", "sneeze", "cry", "laugh", "look", "watch", "listen", "cough", "sleep"),
}
EXISTENTIAL = ("be", "exist")
ROLES = {
    "nsubj": "Actor", "nsubjpass": "Goal", "dobj": "Goal", "iobj": "Recipient", "attr": "Attribute", "oprd": "Attribute", "pobj": "Circumstance",
    "prep": "Circumstance", "advmod": "Circumstance", "advcl": "Circumstance", "acomp": "Attribute", "xcomp": "Process", "ccomp": "Process", "conj": "Participant", "appos": "Participant",
}


def words(text: Column) -> Column:
    """Lower-case words with inner apostrophes; what stands in double quotes is left out."""
    bare = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "\"[^\"]*\"|“[^”]*”", " "))
    return F.transform(F.regexp_extract_all(bare, F.lit("[a-z]+(?:['’][a-z]+)*"), F.lit(0)), lambda w: F.translate(w, "’", "'"))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once a row however often then names it, in functions of its own too."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def band(text: Column) -> Column:
    """low, median or high by the first marker, flipped by a negator within two words before; null without one."""
    return once(words(text), _band)


def _band(tokens: Column) -> Column:
    one = {w: b for b, m in BANDS.items() for w in m if " " not in w}
    two = {w: b for b, m in BANDS.items() for w in m if " " in w}
    singles = F.create_map(*[F.lit(x) for kv in one.items() for x in kv])
    pairs = F.create_map(*[F.lit(x) for kv in two.items() for x in kv])

    def negated(i: Column) -> Column:
        start = F.greatest(i - WINDOW, F.lit(0))
        before = F.slice(tokens, start + 1, i - start)
        return F.exists(before, lambda w: w.isin(*NEGATORS) | w.endswith("n't"))

    def at(i: Column) -> Column:
        word = F.get(tokens, i)
        pair = F.concat_ws(" ", word, F.get(tokens, i + 1))
        found = F.coalesce(singles[word], pairs[pair])
        flipped = F.when(found == "low", "high").when(found == "high", "low").otherwise(found)
        return F.when(negated(i), flipped).otherwise(found)

    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(F.transform(places, at), lambda b: b.isNotNull()), F.lit(0))


def contradicts(modality: Column, text: Column) -> Column:
    """A hedge with weight 0.8 or more, or an assertion with 0.3 or less."""
    return F.coalesce(once(band(text), lambda b: F.when(b == "low", modality >= 0.8).when(b == "high", modality <= 0.3)), F.lit(False))


def process(lemma: Column, text: Column, tag: Column) -> Column:
    """The process of a clause by its root's lemma, in order of precedence; then by its tag."""
    low = F.lower(lemma)
    out = F.when(low.isin(*VERBS["mental"]), "mental").when(low.isin(*VERBS["relational"]), "relational").when(low.isin(*VERBS["verbal"]), "verbal").when(low.isin(*VERBS["behavioral"]), "behavioral")
    out = out.when(F.lower(F.trim(text)).startswith("there ") & low.isin(*EXISTENTIAL), "existential")
    return out.when(F.substring(tag, 1, 2) == "MD", "mental").otherwise("material")


def process_of_text(text: Column) -> Column:
    """A lexical stand-in for a parser: the first word that is a listed verb, by plain suffixes."""
    known = {v: p for p in ("behavioral", "verbal", "relational", "mental") for v in VERBS[p]}
    forms = {**{v + s: p for v, p in known.items() for s in ("", "s", "ed", "ing")}, "is": "relational", "are": "relational", "was": "relational", "were": "relational", "said": "verbal", "told": "verbal", "knew": "mental", "thought": "mental"}
    first = F.get(F.filter(words(text), lambda w: w.isin(*forms)), F.lit(0))
    lookup = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    return F.coalesce(once(first, lambda w: lookup[w]), F.lit("material"))


def participants(tokens: Column) -> Column:
    """(role, text) of the tokens whose dependency names a participant."""
    roles = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    found = F.filter(tokens, lambda t: F.coalesce(roles[t["dep"]] != "Circumstance", F.lit(False)))
    return F.transform(found, lambda t: F.struct(roles[t["dep"]].alias("role"), t["text"].alias("text")))


def circumstances(tokens: Column) -> Column:
    """dep:text of the tokens whose dependency names a circumstance."""
    names = [d for d, r in ROLES.items() if r == "Circumstance"]
    return F.transform(F.filter(tokens, lambda t: F.coalesce(t["dep"].isin(*names), F.lit(False))), lambda t: F.concat_ws(":", t["dep"], t["text"]))


def lemma(word: Column) -> Column:
    """A listed verb's base form, by plain suffixes; any other word in lower case."""
    bases = sorted({v for p in ("behavioral", "verbal", "relational", "mental") for v in VERBS[p]})
    forms = {v + s: v for v in bases for s in ("ing", "ed", "s", "")}
    lookup = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    low = F.lower(word)
    return F.when(low.isin("is", "are", "was", "were"), "be").otherwise(F.coalesce(F.try_element_at(lookup, low), low))


def is_verb(word: Column) -> Column:
    """Whether a word is a listed verb in one of its plain forms."""
    bases = sorted({v for p in ("behavioral", "verbal", "relational", "mental") for v in VERBS[p]})
    return F.lower(word).isin("is", "are", "was", "were", *[v + s for v in bases for s in ("", "s", "ed", "ing")])

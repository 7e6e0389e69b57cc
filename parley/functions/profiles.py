"""Word classes by language, as data. A profile is a table of (language, class, word); what is built
from it (a trie, a join) doesn't know the classes."""

from __future__ import annotations

#: Classes that say what a clause does, the stronger first.
ACTIONS = ("request", "ask", "deny", "plan", "report")

WORDS: dict[str, dict[str, str]] = {
    "en": {
        "request": "please must should need needs ought", "ask": "who what when where why how which whether", "deny": "not no never none nothing without", "plan": "will shall would going tomorrow soon next",
        "report": "is are was were had has have did been be said", "hedge": "that maybe perhaps might seems about", "purpose": "for so because since", "means": "with by through via", "place": "in on at from into over under near to of",
    },
    "fr": {
        "request": "doit faut devez prie veuillez", "ask": "qui quoi quand où pourquoi comment quel", "deny": "ne pas jamais rien aucun sans", "plan": "sera seront va vont demain bientôt",
        "report": "est sont était étaient avait ont été dit", "hedge": "que probablement semble environ", "purpose": "pour afin car puisque", "means": "avec par via", "place": "dans sur chez vers sous entre depuis de",
    },
    "de": {
        "request": "bitte muss sollte braucht müssen", "ask": "wer was wann wo warum wie welche ob", "deny": "nicht kein nie nichts ohne", "plan": "wird werden morgen bald nächste",
        "report": "ist sind war waren hatte haben gewesen sagte", "hedge": "dass vielleicht wohl scheint etwa", "purpose": "für weil damit denn", "means": "mit durch mittels", "place": "in auf an aus über unter bei von nach zu",
    },
    "es": {
        "request": "debe hay necesita favor deben", "ask": "quién qué cuándo dónde cómo cuál", "deny": "no nunca nada ninguno sin", "plan": "será serán mañana pronto va",
        "report": "es son era eran fue había han sido dijo", "hedge": "que quizás parece acaso", "purpose": "para porque pues", "means": "con por mediante", "place": "en sobre desde hacia bajo entre de a",
    },
}


def entries() -> list[tuple[str, str]]:
    """(word or phrase, class), each word once: in the class that ranks first, then in alphabetical order."""
    rank = {name: i for i, name in enumerate(ACTIONS)}
    found: dict[str, str] = {}
    for classes in WORDS.values():
        for name, words in classes.items():
            for word in words.split():
                known = found.get(word)
                if known is None or (rank.get(name, 9), name) < (rank.get(known, 9), known):
                    found[word] = name
    return sorted(found.items())

"""Hand-written voters of the toxicity label model. Each votes for one label or abstains.

Lexicon voters vote toxic where one of their words occurs. Pattern voters look at how insults are used; they abstain on
texts without a lexicon word, so their patterns are only tried where one occurs. Clean voters vote clean.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import NamedTuple

#: Lexicons by theme and language, as words in lower case.
LEXICONS = {
    "intellect": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile imbeciles dimwit halfwit nitwit brainless dunce cretin fool fools foolish",
    "failure": "loser losers failure failures reject rejects deadbeat nobody washout quitter",
    "worth": "worthless useless pathetic pitiful hopeless lousy despicable contemptible",
    "filth": "trash garbage scum scumbag filth filthy vermin sewage dirtbag slime sleaze",
    "disgust": "disgusting disgusted revolting repulsive vile nasty sickening",
    "mockery": "clown clowns joke laughable ridiculous buffoon jester circus crybaby",
    "person": "jerk jerks creep creeps brat weirdo freak freaks lunatic psycho coward cowards liar liars snake",
    "looks": "ugly fat fatso hideous pig pigs cow hag",
    "animal": "rat rats cockroach maggot maggots parasite parasites leech dog subhuman",
    "profanity": "damn damned crap crappy hell bloody bastard bastards bitch bitches piss pissed",
    "obscenity": "ass asses asshole assholes shit shitty bullshit fuck fucking fucked fucker dick dickhead prick cunt whore slut",
    "hate": "hate hated hateful hatred despise detest loathe abhor",
    "violence": "kill killing murder murderer hang burn strangle stab shoot beat punch smash destroy",
    "threat": "threaten regret suffer payback revenge warning hunt",
    "dismissal": "shut shutup silence begone scram buzz",
    "bigotry": "racist racists sexist nazi nazis fascist fascists bigot bigots savages inferior",
    "german_insult": "idiotin idioten dumm dummkopf trottel depp vollidiot blödmann arsch arschloch drecksack schwein penner versager",
    "german_abuse": "scheiße scheisse mist abschaum dreck wertlos widerlich ekelhaft erbärmlich hass hasse halt maul",
    "french_insult": "idiote idiotes connard connasse imbécile crétin crétine abruti débile salaud salope minable",
    "french_abuse": "merde putain dégoûtant nul pourri haine déteste ordure racaille pathétique",
    "spanish_insult": "idiota idiotas imbécil estúpido estúpida tonto tonta cabrón pendejo gilipollas inútil payaso perdedor",
    "spanish_abuse": "mierda basura asco asqueroso odio puta escoria patético",
    "italian_insult": "stupido stupida cretino cretina scemo deficiente stronzo bastardo fallito pagliaccio",
    "italian_abuse": "merda schifo schifoso spazzatura feccia odio vaffanculo cazzo",
}

#: How insults are used; INSULT stands for any lexicon word.
PATTERNS = {
    "second_person": r"\b(?:you|your|ur|u)\b\W+(?:\w+\W+){0,3}?INSULT",
    "vocative": r"INSULT\W+(?:you|people|like you|and you)\b",
    "such_a": r"\b(?:such|what|you|total|complete|absolute|utter) an? (?:\w+ )?INSULT",
    "called": r"\b(?:is|are|was|were|be|being) (?:\w+ )?(?:a |an |the )?INSULT",
    "degree": r"\b(?:so|very|really|most|too|fucking|damn) INSULT",
    "third_person": r"\b(?:he|she|they|them|those|these)\b\W+(?:\w+\W+){0,2}?INSULT",
    "pair": r"INSULT\W+(?:and |or )?INSULT",
    "shouted": r"INSULT\W{0,2}!",
    "doubled": r"\b(INSULT)\b.{1,400}?\b\1\b",
    "close": r"INSULT(?:\W+\w+){1,12}?\W+INSULT",
    "opening": r"\A\W*(?:\w+\W+){0,4}?INSULT",
    "silencing": r"\b(?:shut (?:up|it)|go to hell|get lost|get out|drop dead|screw you)\b",
    "wish": r"\b(?:hope|wish|should|deserve) (?:you |they |to )?(?:\w+ )?(?:die|suffer|burn|rot|hang)\b",
    "self_harm": r"\bkill (?:yourself|urself|themselves)\b",
    "group_slur": r"\b(?:all|every|these|those) \w+ (?:are|is) (?:\w+ )?INSULT",
    "exclusion": r"\b(?:nobody|no one) (?:likes|wants|needs|asked)\b",
}

#: Words of texts that are seldom toxic.
CALM = {
    "courtesy": "please thanks thank welcome kindly sincerely regards appreciate grateful bitte danke merci gracias grazie",
    "legal": "license licensed copyright warranty liability redistribution permission rights clause",
    "reference": "chapter section figure table appendix references bibliography abstract introduction",
    "practice": "example function install version configure documentation parameter password token",
}

_INSULTS = sorted({w for words in LEXICONS.values() for w in words.split()}, key=len, reverse=True)
_INSULT = "(?:" + "|".join(_INSULTS) + r")\b"


class Text(NamedTuple):
    lower: str  # the whole text
    words: int  # in it
    hits: Mapping[int, int]  # lexicon (then calm lexicon) -> occurrences


def _pattern(p: str) -> Callable[[Text], bool]:
    search = re.compile(p.replace("INSULT", r"\b" + _INSULT), re.S).search
    return lambda t: any(i < len(LEXICONS) for i in t.hits) and search(t.lower) is not None


def _insults(t: Text) -> int:
    return sum(n for i, n in t.hits.items() if i < len(LEXICONS))


def _lexicon(i: int) -> Callable[[Text], bool]:
    return lambda t: i in t.hits


#: Name -> (label voted for, whether it votes). The order numbers the voters.
VOTERS: dict[str, tuple[int, Callable[[Text], bool]]] = (
    {k: (1, _lexicon(i)) for i, k in enumerate(LEXICONS)}
    | {k: (1, _pattern(p)) for k, p in PATTERNS.items()}
    | {
        "several_insults": (1, lambda t: _insults(t) >= 3),
        "several_themes": (1, lambda t: sum(i < len(LEXICONS) for i in t.hits) >= 2),
        "many_themes": (1, lambda t: sum(i < len(LEXICONS) for i in t.hits) >= 4),
        "dense_insults": (1, lambda t: _insults(t) >= max(2, 0.006 * t.words)),
        "very_dense_insults": (1, lambda t: _insults(t) >= max(2, 0.03 * t.words)),
    }
    | {f"calm_{k}": (0, _lexicon(len(LEXICONS) + i)) for i, k in enumerate(CALM)}
    | {
        "no_insult": (0, lambda t: t.words >= 20 and not _insults(t)),
        "long_without_insult": (0, lambda t: t.words >= 300 and not _insults(t)),
        "sparse_insult": (0, lambda t: t.words >= 400 and _insults(t) == 1),
    }
)

#: Word -> lexicons (numbers; those of CALM after those of LEXICONS) that have it.
OF_WORD: dict[str, tuple[int, ...]] = {}
for _i, _words in enumerate([*LEXICONS.values(), *CALM.values()]):
    for _w in _words.split():
        OF_WORD[_w] = (*OF_WORD.get(_w, ()), _i)

_CALLS = [f for _, f in VOTERS.values()]


def cast(text: Text) -> list[int]:
    """Numbers of the voters that vote on a text; the others abstain."""
    return [i for i, f in enumerate(_CALLS) if f(text)]

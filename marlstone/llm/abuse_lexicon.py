"""Words of abusive, hateful and sexual language in four languages, by the role they play in a sentence."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache


_MARKS = re.compile("[\u0300-\u036f]")


def plain(w: str) -> str:
    """Lower case without accents."""
    w = w.lower()
    return w if w.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", w)).replace("ß", "ss")


# Common vocabulary (English, German, French, Spanish), in natural order.
NOUNS = {
    "INSULT": """idiot moron imbecile cretin scumbag bastard bitch asshole arsehole dickhead shithead dipshit jackass dumbass wanker prick twit twat
     halfwit lowlife degenerate slut whore cunt motherfucker fucker douchebag retard nitwit dimwit tosser bellend pillock numpty sleazebag
     arschloch vollidiot wichser mistkerl trottel hurensohn schlampe fotze missgeburt drecksau schwein
     idiota imbecil cabron pendejo gilipollas maricon puta zorra mierda hijoputa
     connard connasse abruti ordure encule salaud salope cretine pute batard petasse""",
    "TAUNT": """fool clown creep pig rat crook thief swine weasel coward liar scum maggot parasite loser dolt dunce simpleton buffoon scoundrel bootlicker
     payaso inutil debile depp penner""",
    "DEHUMAN": """rat vermin cockroach cockroaches subhuman savage animal trash plague disease parasite thief thieves swine pig scum filth garbage lice locust
     beast ape monkey dog leech infestation cancer
     tier tiere ungeziefer ratten abschaum untermenschen viecher
     parasites rats vermine animaux chiens cafards
     basura ratas animales escoria parasitos plaga bestias cucarachas""",
    "GROUP": """immigrant foreigner migrant refugee muslim jew christian hindu believer woman women black white asian african arab gypsy gay lesbian
     homosexual trans disabled cripple folk people tribe race religion nation villagers islanders natives peasants kind
     auslander fluchtlinge juden muslime frauen schwule zigeuner etrangers immigres juifs musulmans femmes noirs arabes
     extranjeros inmigrantes judios musulmanes mujeres negros gitanos""",
    "SEXBODY": """nipple boob tit ass arse cock dick pussy penis vagina breast thigh lips butt crotch clit titten schwanz arsch muschi seins chatte fesses
     tetas polla culo cono pezones""",
    "BODY": "face teeth tooth mouth head skull neck leg arm bone throat rib knee nose fresse zahne gueule dents cara dientes",
    "NUDE": "naked nude topless undressed nackt nacktbilder nue nu desnuda desnudo",
}
WORDS = {
    "YOU": "you your yours yourself ur u du dich dir ihr euch dein deine tu te toi vous votre ta ton eres usted tus ti vosotros",
    "SELF": "i me my myself i'm we our us ich mich mir je moi j'ai yo mi",
    "THEY": "they them their theirs those these folk all every sie ils eux leurs ellos ellas",
    "PROFANE": "fuck fucking fucked shit shitty bullshit damn goddamn bloody crap piss scheisse verdammt merde putain joder cono mierda",
    "NEGTRAIT": """stupid dumb useless spineless worthless pathetic disgusting ugly greedy lying filthy dirty lazy brainless braindead inferior stink stinks
     smell smells steal steals breed breeds multiply criminal criminals primitive rotten dumm dumme faul dreckig bete sale stupide estupido sucio asqueroso asquerosa
     dumber dumbest dim thick""",
    "HARM": """kill murder hurt beat punch slap smack stab shoot hang burn break strangle smash crush rape drown choke wipe whip lynch
     toten schlagen umbringen tuer frapper matar pegar golpear""",
    "DIE": "die dies dead death rot suffer perish disappear verrecken sterben krepieren creve crever mourir morir muera muere",
    "WISH": "hope wish deserve deserves should want gladly pray ojala hoffentlich",
    "EXCLUDE": """deport deported expel expelled sterilise sterilised sterilize sterilized exterminate exterminated eradicate wiped gassed
     banned driven locked segregate segregated raus dehors fuera vertreiben echarlos echar""",
    "SEXVERB": """bang fuck fucking screw ride stroke lick licking suck sucking squeeze undress spank spanked stripped thrust thrusts moan moaned moaning
     panting grope groped fondle masturbate masturbating seduce ficken fickst stohnte follar follarte follarme gemia gemit deshabilla baiser baise""",
    "EXPLICIT": """porn porno xxx blowjob handjob cum cumshot orgasm horny dildo threesome gangbang milf sexting camgirl geil geile orgasme
     cachonda cachondo orgasmo nympho creampie deepthroat""",
    "SENSUAL": """sex sexy lust climax erection escort cams uncensored hardcore pornography sweaty wet sexe sexo seduction lingerie strip striptease""",
    "TERM": """harassment orientation discrimination misconduct gender education policy policies religion report reporting training proposal disclosure survey
     protein feed option options short selling drug infection treatment patients software hygiene control""",
}
PHRASES = {
    "ABUSE": r"""fuck (?:you|off|yourself)|shut (?:up|your mouth)|(?:go to|burn in|rot in) hell|drop dead|get lost|piece of (?:shit|crap|trash|filth)|kiss my (?:ass|arse)
     |waste of (?:\w+ )?(?:space|oxygen|skin|air|life)|human (?:garbage|trash|waste|filth)|son of a bitch|screw you|kys|brain ?dead|go die|dumber than|(?:a|as a) brick|oxygen thie(?:f|ves)|kill yourself
     |halt (?:\w+ )?(?:die fresse|die klappe|das maul)|fick dich|verpiss dich|du (?:\w+ )?(?:sau|hund)|ferme ta gueule|ta gueule|va te faire|nique ta|bande d ?abrutis|fils de pute
     |hij[oa]s? de (?:la )?(?:gran )?puta|vete a la mierda|que te jodan|pedazo de \w+|callate|cierra la boca|so (?:stupid|dumb|ugly|thick)|too (?:stupid|thick|dumb|ugly|dim) to""",
    "THREAT": r"""(?:find|found) (?:out )?where (?:you|he|she|they) lives?|know where (?:you|he|she|they) lives?|watch your back|you (?:will|ll) regret|(?:will|ll|gonna|going to) (?:get|find|hurt|kill|end|destroy|come for) (?:you|him|her|them)
     |you are (?:a )?dead|(?:better|should) (?:run|hide)|(?:hit|run over) by a|teach (?:you|him|her|them) a lesson|no(?:body| one) (?:would|will) miss|put (?:you|him|her|them) (?:in|under) the ground""",
    "DENY": r"""no rights|lesser (?:race|kind|sort|people|breed)|inferior (?:race|people)|in their blood|born (?:thieves|criminals|liars)|no place (?:among|here|in)
     |belong in the kitchen|go back (?:to|where)|(?:out of|from) (?:our|the|this) country|have children|live off (?:us|the rest)|ruin everything|lock (?:\w+ ){1,4}(?:away|up)|ship (?:them|\w+) off|wiped? (?:\w+ )?(?:out|off)|get rid of (?:them|all)|kept apart|keep (?:\w+ ){1,2}out of""",
    "SUBHUMAN": r"""not (?:even )?(?:human|people|persons)|less than human|subhumans?|keine menschen|untermenschen|sous ?hommes|ni siquiera son personas|no son (?:humanos|personas)|pas (?:des )?humains""",
    "OFFER": r"""(?:naked|nude|topless|sexy|dirty|hot) (?:\w+ )?(?:pic|pics|picture|pictures|photo|photos|selfie|selfies|video|videos|cams?|body)|(?:hot|wild|rough|oral|anal) sex|sex (?:tape|tapes|toy|chat|slave|all night|with (?:you|me))
     |get naked|in bed with|all night long|turn(?:s|ed)? (?:me|you) on|make (?:her|him|me|you) come|touch(?:ing)? (?:myself|yourself|himself|herself|themselves|each other)|take it in|from behind|every inch|(?:her|his|my|your) clothes off|off (?:her|his) clothes""",
    "SELFBE": r"\b(?:i|we) (?:was|am|feel|felt|were|must have been|have been|sound|look)\b|\bi m (?:such |so )?(?:an? )?\w+|\bme (?:an? )?(?:idiot|fool|moron)\b|\bshame on me\b",
    "THING": r"""(?:damn|fucking|shitty|stupid|dumb|bloody|crap|garbage|useless|dirty|ugly|sick|killer|rotten) (?:good |fine )?(?:numbers?|quarter|data|chart|spreadsheet|form|website|price|stock|file|files|column|columns|market|call|table|report|fee|fees|system|code|query|join|weather|coffee)""",
}

#: What a role, or two roles in one sentence, say before any label is seen: log odds for (abusive, hateful, sexual).
PRIOR = {
    "INSULT": (5.2, 0, 0), "TAUNT": (2.5, 0, 0), "TAUNT+YOU": (2.0, 0, 0), "PROFANE+TAUNT": (2.5, 0, 0), "NEGTRAIT+TAUNT": (1.5, 0, 0), "SELFBE+TAUNT": (-3.0, 0, 0), "INSULT+YOU": (2.5, 0, 0), "INSULT+PROFANE": (2.5, 0, 0), "INSULT+SELFBE": (-5.0, 0, 0), "ISINSULT": (2.5, 0, 0), "INSULT+NEGTRAIT": (1.5, 0, 0),
    "ABUSE": (6.5, 0, 0), "ABUSE+SELFBE": (-3.0, 0, 0), "THREAT": (6.0, 0, 0), "HARM+YOU": (2.5, 0, 0), "BODY+HARM": (3.0, 0, 0), "HARM+WISH": (1.5, 0, 0), "DIE+YOU": (2.5, 0, 0),
    "DIE+WISH": (4.0, 0, 0), "DIE+HARM": (1.5, 0, 0), "NEGTRAIT+YOU": (3.0, 0, 0), "NEGTRAIT": (1.0, 0.5, 0), "PROFANE+YOU": (2.0, 0, 0), "PROFANE": (0.5, 0, 0),
    "THING": (-3.0, -1.0, -1.0), "SELFBE": (-2.0, -1.0, -0.5),
    "DEHUMAN": (0.5, 0.8, 0), "ISDEHUMAN": (0.5, 4.5, 0), "DEHUMAN+GROUP": (0, 4.0, 0), "DEHUMAN+THEY": (0, 1.5, 0), "EXCLUDE+GROUP": (0, 4.5, 0), "EXCLUDE": (0, 1.5, 0), "EXCLUDE+THEY": (0, 2.5, 0), "SUBHUMAN": (0, 5.5, 0), "NEGTRAIT2": (1.0, 2.0, 0),
    "GROUP+NEGTRAIT": (0, 3.0, 0), "NEGTRAIT+THEY": (0, 1.5, 0), "DENY": (0, 3.5, 0), "DENY+GROUP": (0, 2.5, 0), "DENY+THEY": (0, 2.0, 0), "GROUP+HARM": (0, 2.0, 0), "GROUP+THEY": (0, 0.5, 0),
    "EXPLICIT": (0, 0, 5.0), "SENSUAL": (0, 0, 1.8), "SEXUAL2": (0, 0, 3.0), "SEXBODY": (0, 0, 1.8), "SEXVERB": (0, 0, 1.8), "NUDE": (0, 0, 1.8), "NUDE+YOU": (0, 0, 2.0),
    "OFFER": (0, 0, 5.5), "TERM": (-1.0, -1.0, -2.0), "EXPLICIT+TERM": (0, 0, -3.0), "SENSUAL+TERM": (0, 0, -2.0), "NUDE+TERM": (0, 0, -3.0), "SEXBODY+TERM": (0, 0, -2.0), "TAUNT+TERM": (-1.5, 0, 0), "DEHUMAN+TERM": (-1.5, -1.5, 0),
}
BIAS = (-4.6, -4.6, -4.6)


def _plural(w: str) -> set[str]:
    return {w, w + ("es" if w.endswith(("s", "sh", "ch", "x")) else "s"), *({w[:-1] + "ies"} if w.endswith("y") else ())}


def _any(*roles: str) -> str:
    return "(?:" + "|".join(sorted({f for r in roles for w in map(plain, NOUNS[r].split()) for f in _plural(w)})) + ")"


ROLE: dict[str, set[str]] = {}
for _role, _ws in NOUNS.items():
    for _w in map(plain, _ws.split()):
        for _f in _plural(_w):
            ROLE.setdefault(_f, set()).add(_role)
for _role, _ws in WORDS.items():
    for _w in map(plain, _ws.split()):
        ROLE.setdefault(_w, set()).add(_role)
for _w in WORDS["HARM"].split()[:24]:
    for _f in (_w + "s", _w + "ed", _w + "ing", _w.rstrip("e") + "ing", _w + _w[-1] + "ed", _w + _w[-1] + "ing"):
        ROLE.setdefault(_f, set()).add("HARM")
_be, _fill = "(?:are|is|was|were|be|re|sind|ist|bist|sont|est|es|eres|son|such|you|du|breed like|multiply like)", "(?:(?:a|an|all|just|nothing but|total|complete|real|right|des|de|la|le|les|una|un|ein|eine|espece de) )*"
PHRASES |= {
    "ISDEHUMAN": f"(?:(?:{_be}|those|these|diese|ces|esas|esos) {_fill}{_any('DEHUMAN')}|{_any('DEHUMAN')} (?:the lot of|all of) (?:them|you))",
    "ISINSULT": f"(?:{_be} {_fill}{_any('INSULT', 'TAUNT')}|{_any('INSULT', 'TAUNT')} (?:the lot of|all of) (?:them|you))",
}
PHRASE = [(role, re.compile(p if role == "SELFBE" else r"\b(?:" + re.sub(r"\n\s+", "", p) + r")\b")) for role, p in PHRASES.items()]
SEXUAL = {"SEXBODY", "NUDE", "SEXVERB", "EXPLICIT", "SENSUAL"}
#: Every word with a role that tells of such content: what a disguised word may stand for.
TELLING = {w for w, rs in ROLE.items() if rs & {"INSULT", "TAUNT", "DEHUMAN", "PROFANE", "NEGTRAIT", "EXCLUDE", "DIE", *SEXUAL} and len(w) > 2}
#: Words that phrases are made of, and those of them without which no phrase is there.
PHRASE_WORDS = {w for p in PHRASES.values() for w in re.findall(r"[a-z]{2,}|\b[imad]\b", re.sub(r"\\[a-z]", " ", p))}
_COMMON = set("a an the is are was were be am i we me m s re ll you he she it they them him her his my your our to of in on by for and or so no not such all just la de des es son das die le los las be de va out this from one would will s t re up off with where who real right total complete every").union("u w d")
_KEYS = PHRASE_WORDS - _COMMON


@lru_cache(maxsize=1 << 16)
def _features(found: frozenset[str]) -> tuple[str, ...]:
    one = sorted(found)
    return tuple(f for f in one + [f"{a}+{b}" for i, a in enumerate(one) for b in one[i + 1 :]] if f in PRIOR)


def roles(words: list[str]) -> tuple[str, ...]:
    """The roles, and pairs of roles, that have odds set, in one sentence of plain words."""
    found: set[str] = set()
    sexual = traits = 0
    for w in set(words):
        if w in ROLE:
            found |= ROLE[w]
            sexual += not SEXUAL.isdisjoint(ROLE[w])
            traits += "NEGTRAIT" in ROLE[w]
    if sexual > 1:
        found.add("SEXUAL2")
    if traits > 1:
        found.add("NEGTRAIT2")
    if not _KEYS.isdisjoint(words) or "i" in words or "me" in words:
        sentence = " ".join(words)
        for role, p in PHRASE:
            if p.search(sentence):
                found.add(role)
    return _features(frozenset(found))

"""Abusive, hateful or sexually explicit passages.

One Aho-Corasick automaton holds a weighted lexicon of words and phrases in five languages. Single
words insult or are obscene by themselves or with company; threats, wishes of harm and demeaning
judgements are built from parts by rule (a verb of killing and whom it is aimed at, a verb of hurting
and a part of the body, a group and what it is called); settings in which such words mean something
else, and phrases that only name them, take their weight away. It runs over the whole text after
folding: look-alike letters, digits and signs for letters, letters set apart by signs, stretched and
swapped letters. Hits are summed by passage, a sentence or at most PASSAGE words of it; a document
has the score of its worst passage, and beside it the weight of all passages by its length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.mixing import plain_source

THRESHOLD = 1.0
PASSAGE = 40  # words that one passage may have; a longer sentence has several

# Words and phrases with the weight of their block.
# Words that insult or are obscene by themselves.
STRONG = """
fuck fucks fucked fucker fuckers fucking fuckwit motherfucker motherfuckers cunt cunts wanker wankers arsehole
arseholes asshole assholes dickhead dickheads shithead shitheads shit shits shitty shite bullshit bastard bastards
bitch bitches slut sluts slutty whore whores twat twats prick pricks tosser tossers bellend retarded retards faggot
faggots nigger niggers paki pakis kike kikes spastic spastics tranny cock cocks dick dicks pussy tits titties boobs
blowjob handjob cum horny porn porno pornstar dildo wank wanking masturbate masturbating jerkoff gangbang anal
blowjobs nudes scum scumbag scumbags arse piss pissed bollocks
connard connards connasse salaud salauds salope salopes enculé enculés encule encules putain pute putes foutre
gueule merde bougnoule nique niquer bâtard
arschloch arschlöcher wichser hurensohn hurensöhne missgeburt missgeburten drecksau drecksäue fotze fotzen schlampe
schlampen fresse verpisst verpiss fick ficken fickt scheisse scheiße scheißkerl
gilipollas cabrón cabrones puta putas puto putos mierda mierdas jodan joder jódete coño maricón maricones pendejo
pendejos imbéciles hijoputa cállate
bangsat celaka sial bodoh babi mampus jadah pukimak lancau pantat sundal keparat
"""
# Insults that some contexts use otherwise; they count with the person they are aimed at.
MILD = """
idiot idiots moron morons imbecile imbeciles cretin cretins halfwit halfwits parasite parasites leech leeches leeche
vermin filth swine pig pigs rat rats maggot maggots cockroach cockroaches bloodsucker bloodsuckers degenerate
degenerates animal animals clown clowns crooked thieving worthless stinking slimy toothless inbred spineless filthy
suck sucks sucked sucking pathetic rotten lying lazy greedy useless stupid ugly dumb cripple cripples naked nude nudes breasts thighs grope
groping spank spanking lick licking stripper undress undressed selfies sexy kinky orgasm erotic nipples bloody
anjing abruti abrutis ordure ordures porc porcs rats ratten ratte schwein schweine idioten idiot cerdo cerdos rata ratas
parásito parásitos imbécil tikus kotor haram
"""
# Phrases that threaten, demean or solicit whatever else the sentence says.
PHRASES = """
go to hell
crawl back under
shut your mouth
shut your face
waste of skin
off the sole of my boot
off the sole of my shoe
you deserve to be
deserve to be shot
every last one of you
you could not run a
nobody would miss you
jump off your own
go and die
kill yourself
die in a ditch
hang yourself
drown yourself
found face down
one night i will break
i will break your
i know where you live
i am bringing a knife
i am bringing a crowbar
i am bringing petrol
i am bringing my brothers
you will all be sorry you were born
you will all be screaming
you will all be begging
you will be sorry you were born
before somebody does us all a favour
before somebody sets it on fire
before somebody stamps on you
kept on a leash
fed from a bowl
and that lot are born
lot are born
should be driven out
should be wiped out
would be if they were wiped out
were wiped out
were shipped off and sunk
were put in cages
were sterilised
should be sterilised
should be shot
should be exterminated
should be put down
should be gassed
are a disease
are vermin
are filth
are animals
are subhuman
they breed like
they foul everything they touch
they steal as they breathe
should ever be opened for
belong in the kitchen
belong on their knees
belong behind a fence
belong in chains
belong in cages
i come thinking of it
sucked me off
suck me off
rode me right there
wet mouth on my
tore open my trousers
unzipped my trousers
pulled down my trousers
tore open my blouse
i would pay to grope
i want to strip the
i want to bend over the
bend you over
send me nude
send me naked
send me your naked
send me your nude
suck my
lick my
i get hard every time
i get wet every time
i get horny
nothing but rotten
nothing but worthless
nothing but pathetic
hijos de puta
hijo de puta
que os jodan
habría que quemarlos vivos
quemarlos vivos
pedazo de
allez vous faire
ferme ta gueule
méritent d'être pendus
méritent d'etre pendus
vous êtes tous des
ihr seid alle
halt die fresse
verpisst euch
gehören eingesperrt oder erschlagen
gehören erschlagen
patut dipukul sampai mati
dipukul sampai mati
pergi mampus
haram jadah
bodoh macam babi
tikus kotor
kamu semua bodoh
tutup mulut
"""
# Half a threat or insult: needs company.
HINTS = """
i know where
one night
i want to
every time
you have
face down
what a
would write rules like
with a brain that small
i would pay
right there in
send me
nothing but
"""
# Parts of which threats, wishes and judgements are built.
KILL = "kill murder strangle stab shoot hang drown lynch rape gas behead butcher slaughter torture castrate execute poison burn exterminate choke".split()
AIMED = """
you|you all|you both|all of you|every one of you|the lot of you|your family|your wife|your husband|your children|your kids|your son|your daughter|your sister|your mother|your brother
them all|him and his family|her and her family|those bastards|these people|those people
""".strip().replace("\n", "|").split("|")
HURT = "break smash slit crush bash punch snap slash carve rip tear stamp kick knock cave burn cut".split()
BODY = "throat neck legs leg jaw kneecaps knees fingers arms arm skull face head bones nose ribs spine wrists eyes tongue teeth".split()
GROUPS = """
jews muslims christians hindus sikhs buddhists arabs africans asians blacks whites indians chinese mexicans turks poles romanians gypsies immigrants migrants foreigners refugees
women girls gays lesbians homosexuals transsexuals cripples beggars natives
""".split()
CALLED = "vermin|filth|parasites|animals|rats|pigs|dogs|apes|monkeys|cockroaches|subhuman|subhumans|scum|savages|trash|garbage|dirt|inferior|a disease|a plague|a cancer|a curse|not human|not even human|leeches|maggots".split("|")
WISHES = """
deserve to die|deserve to burn|deserve to suffer|deserve to hang|deserve to be hanged|deserve to be killed|do not deserve to live|don't deserve to live|should all die|should all be killed
should be killed|should be hanged|should be lynched|should be whipped|should be castrated|should be burned alive|should be burnt alive|should burn in hell|must be exterminated|have to be exterminated
must all die|rot in hell|burn in hell|drop dead|hope you die|hope they die|hope you get cancer|hope you choke|hope they choke|wish you were dead|wish they were dead|better off dead
go back to your country|go back where you came from|go back to where you came from|not welcome in our country|only good for breeding|belong in a zoo|belong in the gutter|belong in a camp
je vais te tuer|je vais vous tuer|on va te tuer|sale arabe|sale juif|sale noir|sales arabes|sales juifs|va te faire|crève donc|ich bringe dich um|ich bringe euch um|ich mach dich fertig
ausländer raus|stück scheisse|stück scheiße|te voy a matar|os voy a matar|vete a la mierda|hijos de perra|hijo de perra|aku bunuh kau|saya akan bunuh|pergi mati
""".strip().replace("\n", "|").split("|")
EXPLICIT = """
thrust into her|thrust into him|thrust inside her|thrust deep inside|spread her legs|spread my legs|spread your legs|between her thighs|between my thighs|between his thighs
her bare breasts|her naked body|his naked body|my naked body|his erection|her clitoris|sat on my face|moaned as he|moaned as she|moaning as he|moaning as she|he came inside|came in my mouth|came on her face
raped her again|raped me again|forced himself on her|forced himself on me|slid his hand up her skirt|slid his hand inside her|kissed her breasts|licked her nipples|sucked his cock|on her knees in front of him
made love to me on|had sex with her on|had sex with me on|want to have sex with you|sleep with me and i will|show me your body|touch yourself
""".strip().replace("\n", "|").split("|")
# Uses that are no abuse; they cancel the words inside them.
EXCEPTIONS = """
-1.0 kill switch
-1.0 dead-hand
-1.0 dead hand
-1.0 abusive trading
-1.0 penetration test
-1.0 penetration testing
-1.0 dummy variable
-1.0 domestic abuse
-1.0 financial abuse
-0.7 lazy evaluation
-0.7 lying in
-0.7 lying on
-0.7 naked short
-0.7 naked option
-0.7 naked position
-1.0 cock valve
-1.0 stop cock
-1.0 weather cock
-1.0 shoot you an
-1.0 shoot you a
"""
# Settings in which the words behind them are meant literally: words of a passage that tell the setting.
SETTINGS = {
    "sow sows ewe ewes mare mares cow cows cattle dog dogs puppy puppies litter litters breed breeds kennel kennels livestock herd herds poultry hen hens farm farms abattoir veterinary slaughterhouse welfare": "pig pigs rat rats bitch bitches cock cocks swine animal animals dogs porc porcs rats schwein schweine cerdo cerdos babi tikus maggot maggots leech leeches cockroach cockroaches vermin parasite parasites",
    "cancer prostate cervical screening tumour tumor patient patients surgery surgical clinic medical diagnosis hospital mammogram": "breasts anal nipples tits spastic spastics cripple cripples thighs naked",
    "sans en le du délai échéance paiement jours": "retard retards",
}
# Wordings that name an offence or a word and do not use it; unless the passage is aimed at someone.
MENTIONS = """
sexual harassment|harassment policy|hate speech|hate crime|hate crimes|racial slur|racial slurs|slurs such as|slurs like|a slur|offensive term|offensive terms|offensive language|abusive language
words such as|words like|terms such as|terms like|the word|the words|the term|swear words|swearing|profanity|content policy|discrimination|training on|code of conduct|disciplinary
""".strip().replace("\n", "|").split("|")
# Words that a swap of letters in the lexicon would hit.
PLAIN = """
arts rase ares stat tist chat clam lick slick lays lien spit sits sift cool slot salt lust tars star
tsar arse sire coke coca dcik pier tried pint print rial sail lain saint strip mired denim lived drawn
diet tide edit tied tired art tar angle form from unde dune nude dame untied united pure erupt super
abus asme same mane name trail trial piglet lair liar rail snail nails slain sale seal lion loin ratio
rate rates grape gorpe parse spare spear pears reaps
"""

# Letters of other alphabets and the Latin letter each resembles.
LOOKALIKES = """
а=a в=b с=c ԁ=d е=e ё=e ә=e є=e ғ=f ɡ=g һ=h н=h і=i ї=i ɩ=i ј=j к=k ӏ=l м=m п=n о=o р=p ԛ=q г=r ѕ=s т=t ц=u у=y ѵ=v ԝ=w х=x ү=y з=3 ь=b
α=a β=b ε=e η=n ι=i κ=k ν=v ο=o ρ=p τ=t υ=u χ=x γ=y ω=w ѡ=w ϲ=c ı=i ł=l ø=o đ=d ʀ=r ɴ=n ɪ=i ᴀ=a ʙ=b ᴄ=c ᴅ=d ᴇ=e ʜ=h ᴋ=k ʟ=l ᴍ=m ᴏ=o ᴘ=p ᴛ=t ᴜ=u
"""
_PAIRS = [pair.split("=") for pair in LOOKALIKES.split()]
_FOLD = {ord(a): b for a, b in _PAIRS} | {ord(a.upper()): b for a, b in _PAIRS if len(a.upper()) == 1 and not a.upper().isascii()}
_FOLD |= dict.fromkeys([*range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF, 0xAD, 0x180E, *range(0x300, 0x370)])
_FOLD |= {0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0x2010: "-", 0x2011: "-", 0x2013: "-", 0x2014: "-", 0xA0: " "}
_SIGNS = str.maketrans("0134578@$!|+", "oieastbasilt")
_APART = re.compile(r"(?<![^\W_])(?:[^\W_][._*\-]){2,}[^\W_](?![^\W_])|(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")
_SIGNED = re.compile(r"(?<![^\W_])(?:[a-z]+[0-9@$!|+]|[@$!|+0-9]+[a-z])[a-z0-9@$!|+]*")
_MASKED = re.compile(r"(?<![^\W_])[a-z]{1,3}[*#]+[a-z$]{1,4}(?![^\W_*#])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_WORDS = re.compile(r"\w+")
_ENDS = re.compile(r"[.?!\n]+(?=\s|$|[\"'”)])|\n")
_YOU = re.compile(r"\b(?:you|your|yours|yourself|vous|ta|tu|ihr|du|euch|sois|os|kamu|vosotros|ustedes)\b")
#: What stands for a word with letters struck out. With one letter on each side it may be a product.
MASK, MASK_SHORT = "\x01masked\x01", "\x01short\x01"


def _unsign(match: re.Match) -> str:
    word = match.group()
    if sum(c.isalpha() for c in word) < 2 or word[-1] in "!|+" and word[:-1].isalpha():
        return word
    return word.translate(_SIGNS)


def fold(text: str) -> str:
    """Lower case with disguises undone: the string the automaton reads."""
    t = text
    if not t.isascii():
        t = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", t).translate(_LOOSE) if _mixed(t) else t.translate(_INVISIBLE))
    t = t.lower()
    if "_" in t or "." in t or "-" in t or "*" in t or " " in t:
        t = _APART.sub(lambda m: re.sub(r"[._*\- ]", "", m.group()), t)
    if "*" in t or "#" in t:
        t = _MASKED.sub(lambda m: f" {MASK if len(m.group()) > 3 else MASK_SHORT} ", t)
    t = _SIGNED.sub(_unsign, t)
    return _STRETCHED.sub(r"\1", t)


_INVISIBLE = dict.fromkeys([*range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF, 0xAD, 0x180E]) | {0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0xA0: " "}
_LOOSE = _INVISIBLE | {k: v for k, v in _FOLD.items() if v and k > 0x36F} | {k: v for k, v in _FOLD.items() if k < 0x300}


def _mixed(t: str) -> bool:
    """Whether the text has letters of other alphabets than the Latin one, or full-width ones."""
    return any("Ͱ" <= c <= "ԯ" or "＀" <= c <= "￯" or "ɐ" <= c <= "ʯ" or c >= "\U0001d400" for c in t)


def _swapped(word: str) -> Iterator[str]:
    for i in range(len(word) - 1):
        if word[i] != word[i + 1]:
            yield word[:i] + word[i + 1] + word[i] + word[i + 2 :]


@lru_cache(1)
def automaton():
    """Entries (length, weight, hint), built once in each Python worker from the lists above."""
    import ahocorasick

    entries: dict[str, float] = {}
    words: dict[str, float] = {}
    for block, weight in ((MILD, 0.7), (STRONG, 1.0)):
        words |= dict.fromkeys(block.split(), weight)
    plain = set(PLAIN.split()) | set(words)
    for word, weight in words.items():
        if len(word) >= 4:
            for other in _swapped(word):
                if other not in plain:
                    entries[other] = min(weight, 0.7) if len(word) < 5 else weight
        if "l" in word and word.replace("l", "i") not in plain:  # a figure 1 folds to i
            entries[word.replace("l", "i")] = weight
        once = _STRETCHED.sub(r"\1", re.sub(r"(.)\1", r"\1", word))
        if once != word and once not in plain:  # "asssshole" folds to one s
            entries[once] = weight
    entries |= words
    for line in PHRASES.strip().splitlines():
        entries[line.strip()] = 1.0
    for line in HINTS.strip().splitlines():
        entries.setdefault(line.strip(), 0.3)
    entries |= {MASK: 1.0, MASK_SHORT: 0.7}
    for phrase in _built():
        entries.setdefault(phrase, 1.0)
    for line in EXCEPTIONS.strip().splitlines():
        weight, _, phrase = line.strip().partition(" ")
        entries[phrase] = float(weight)
    a = ahocorasick.Automaton()
    for text, weight in entries.items():
        a.add_word(text, (len(text), weight, text))
    for text in MENTIONS:
        if text not in entries:
            a.add_word(text, (len(text), 0.0, text))
    a.make_automaton()
    return a


def _built() -> Iterator[str]:
    """Threats, wishes and judgements made of the parts above, explicit ones included."""
    for verb in KILL:
        for whom in AIMED:
            yield f"{verb} {whom}"
        for group in GROUPS:
            yield from (f"{verb} {group}", f"{verb} the {group}", f"{verb} all {group}", f"{verb} all the {group}", f"{verb} those {group}", f"{verb} these {group}")
    for verb in HURT:
        for part in BODY:
            if (verb, part) != ("cut", "teeth"):
                yield from (f"{verb} {whose} {part}" for whose in ("your", "his", "her", "their", "some"))
    for group in GROUPS:
        yield from (f"{group} are {what}" for what in CALLED)
        yield from (f"{group} are all {what}" for what in CALLED)
    yield from WISHES
    yield from EXPLICIT


@lru_cache(1)
def _settings() -> tuple[list[tuple[set[str], set[str]]], set[str]]:
    return [(set(k.split()), set(v.split())) for k, v in SETTINGS.items()], set(MENTIONS)


def score(text: str | None) -> tuple[float, int, float]:
    """(score of the worst passage, passages at or above the threshold, weight a thousand words).

    Null or blank text: (0, 0, 0)."""
    if not text:
        return 0.0, 0, 0.0
    t = fold(text)
    hits = []
    for end, (size, weight, entry) in automaton().iter(t):
        a, b = end - size + 1, end + 1
        if (a == 0 or not t[a - 1].isalnum()) and (b == len(t) or not t[b].isalnum()):
            hits.append((a, b, weight, entry))
    if not any(w >= 0.7 for _, _, w, _ in hits):
        return 0.0, 0, 0.0
    edges = [m.end() for m in _ENDS.finditer(t)] + [len(t)]
    worst, bad, whole, k = 0.0, 0, 0.0, 0
    hits.sort()
    while k < len(hits):
        here = hits[k][0]
        stop = next(e for e in edges[_at(edges, here) :] if e > here)
        start = edges[_at(edges, here) - 1] if _at(edges, here) else 0
        own = []
        while k < len(hits) and hits[k][0] < stop:
            own.append(hits[k])
            k += 1
        for passage, a, b in _passages(own, t, start, stop):
            s = _passage_score(passage, t[a:b])
            worst, bad, whole = max(worst, s), bad + (s >= THRESHOLD), whole + s
    return round(worst, 4), bad, round(1000 * whole / max(1, len(_WORDS.findall(t))), 4)


Hit = tuple[int, int, float, str]


def _passages(hits: list[Hit], t: str, start: int, stop: int) -> Iterator[tuple[list[Hit], int, int]]:
    """(hits, start, stop) of a sentence: itself, or the stretches of at most PASSAGE words from each hit on.

    A hit of a long sentence is in every stretch that it fits in, so none is told apart from its company."""
    words = [m.start() for m in _WORDS.finditer(t, start, stop)]
    if len(words) <= PASSAGE:
        yield hits, start, stop
        return
    import bisect

    last = -1
    for i, (a, _, _, _) in enumerate(hits):
        first = max(0, bisect.bisect_right(words, a) - 1)
        end = words[first + PASSAGE] if first + PASSAGE < len(words) else stop
        k = next((j for j in range(i, len(hits)) if hits[j][1] > end), len(hits))
        if k > last:  # else all of its hits are in the stretch before
            yield hits[i:k], words[max(0, first - 5)], end
            last = k


def _at(edges: list[int], x: int) -> int:
    import bisect

    return bisect.bisect_right(edges, x)


def _passage_score(hits: list[Hit], passage: str) -> float:
    total, until = 0.0, -1
    settings, mentions = _settings()
    words = set(_WORDS.findall(passage))
    literal = set().union(*(meant for told, meant in settings if words & told))
    named = any(entry in mentions for *_, entry in hits)
    aimed = bool(_YOU.search(passage))
    strong = False
    for a, b, w, entry in sorted(hits, key=lambda h: (h[0], -h[1])):
        if entry in literal and not aimed or (named and not aimed and " " not in entry):
            continue
        if w < 0 or a >= until:  # of overlapping entries the longest from the left counts
            total += w
            until = max(until, b if w else -1)
        strong |= w >= 0.7
    if total <= 0 or not strong:
        return 0.0
    return total + (0.3 if aimed else 0.0)


def content_scores(documents: DataFrame) -> DataFrame:
    """doc_id, source, score, passages, density for every document; null and blank texts score 0.

    ``score`` is that of the worst passage, ``density`` the weight of all passages a thousand words.

    Scored where it is read: no shuffle, whole texts, repeated rows scored each."""

    @F.pandas_udf("score double, passages int, density double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([score(t) for t in batch], columns=["score", "passages", "density"])

    return documents.select("doc_id", plain_source("source").alias("source"), run("text").alias("s")).select("doc_id", "source", "s.score", "s.passages", "s.density")


def unsafe_documents(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The ids of documents with a passage at or above the threshold."""
    return content_scores(documents).where((F.col("score") >= threshold) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def source_rates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """source, documents, unsafe, rate: shares of unsafe documents of each source, null its own."""
    unsafe = F.sum((F.col("score") >= threshold).cast("long"))
    return content_scores(documents).groupBy("source").agg(F.count("*").alias("documents"), unsafe.alias("unsafe"), F.avg((F.col("score") >= threshold).cast("double")).alias("rate"))

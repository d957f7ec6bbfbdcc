"""Fixed values and parsing for names of persons and organisations."""

from __future__ import annotations

import html
import re
import unicodedata

#: Common short forms of given names and what they stand for.
NICKNAMES = """
abby:abigail al:albert,alan,alfred alex:alexander,alexandra ali:alison andi:andreas andy:andrew angie:angela
art:arthur barb:barbara bea:beatrice becky:rebecca bella:isabella ben:benjamin beppe:giuseppe bernie:bernard
bert:albert,robert beth:elizabeth betty:elizabeth bill:william billy:william bob:robert bobby:robert cathy:catherine
charlie:charles chris:christopher,christine christa:christine chuck:charles cindy:cynthia conny:constanze,cornelia
dan:daniel danny:daniel dave:david deb:deborah debbie:deborah detta:bernadette dick:richard dima:dmitri dolly:dorothy
don:donald dora:theodora dorie:dorothy doug:douglas drew:andrew ed:edward eddie:edward ellie:eleanor etta:henrietta
fran:frances francie:frances frank:francis franz:franziskus fred:frederick freddy:frederick gabi:gabriele gene:eugene
geoff:geoffrey gerry:gerald gina:regina greg:gregory greta:margarete gus:augustus hal:harold hank:henry hanna:johanna
hans:johannes harry:harold,henry ike:isaac jack:john jake:jacob jan:johannes jeff:jeffrey jenny:jennifer jerry:gerald
jess:jessica jim:james jimmy:james joe:joseph joey:joseph jon:jonathan josh:joshua judy:judith kalle:karl
kate:katherine kathy:katherine katie:katherine katya:ekaterina ken:kenneth kim:kimberly kit:christopher klaus:nikolaus
larry:lawrence lena:helena leo:leonard lew:lewis lisa:elizabeth liv:olivia liz:elizabeth liza:elizabeth lola:dolores
lupe:guadalupe maggie:margaret manny:emmanuel marge:margaret marty:martin matt:matthew max:maximilian meg:margaret
mia:maria mick:michael mickey:michael mike:michael misha:mikhail mitch:mitchell molly:mary nacho:ignacio nan:anna
nate:nathaniel ned:edward nell:eleanor nick:nicholas nora:eleanor paco:francisco pam:pamela pancho:francisco
pat:patricia,patrick patty:patricia paula:pauline peg:margaret peggy:margaret pepe:jose pete:peter phil:philip
polly:mary rafa:rafael ray:raymond rich:richard rick:richard rob:robert robbie:robert ron:ronald rosie:rosemary
roxy:roxanne rudi:rudolf russ:russell sally:sarah sam:samuel,samantha sandy:alexandra sasha:alexander sepp:josef
shura:alexandra sid:sidney stan:stanley steff:stefanie steve:stephen sue:susan susie:susan tanya:tatiana ted:theodore
terry:terence theo:theodore tim:timothy tina:christina toby:tobias tom:thomas tommy:thomas tony:anthony trudi:gertrud
uli:ulrich uschi:ursula val:valerie vicky:victoria vince:vincent volodya:vladimir walt:walter wendy:gwendolyn
will:william willy:wilhelm winnie:winifred zach:zacharias zack:zacharias zhenya:yevgeniya
"""
#: Words for a line of business, their short forms first, the full word last.
BUSINESS = """
acad:academy adv:advertising agcy:agency assoc:associates auto:automotive bros:brothers constr:construction
consult:consulting creat:creative dev:development des:design dig:digital edu:education elec:electronics eng:engineering
ent:entertainment envir:environmental evt:event fin:financial grp:group hlth:health ind:industries inst:institute
intl:international lab:laboratories labs:laboratories log:logistics mfg:manufacturing mgmt:management mktg:marketing
net:networks pharm:pharmaceuticals prod:productions publ:publishing res:research sec:security soln:solutions
solns:solutions sol:solutions svc:services svcs:services sw:software sys:systems tech:technologies telecom:telecommunications
trd:trading univ:university
"""
#: Full words for a line of business that have no short form above.
BUSINESS_WORDS = """
analytics agency apps architects bakery bank books brewery care catering cloud clothing commerce data energy events
farm farms fashion food foods furniture games garden gardens graphics hosting hotels insurance interactive jewelry law
legal lighting media medical motors music partners photography plugins plumbing press print printing properties repair
school shop sports store studio studios supplies supply themes tours toys transport travel ventures video web wines
works apparel accounting laboratory technology solution service system event holdings trading
"""
#: Forms of incorporation, without dots.
LEGAL_FORMS = """
ab ag aktiebolag aps bv corp corporation company co eurl gesellschaft gmbh inc incorporated kg limited limitada llc llp lp
ltd mbh nv oy oyj plc proprietary pte pty sa sarl sas sl sociedad spa srl ug
"""
#: Credits that name nobody in particular.
NOBODY = """
admin|administrator|anon|anonymous|author|authors|contributor|contributors|default|developer|developers|guest|me|n a|na|
name|nobody|none|null|owner|plugin author|plugin authors|plugin developer|plugin team|root|team|test|the author|the team|
unknown|unnamed|user|various|webmaster|your name|your company|my name|first last|john doe|example
"""
#: Titles and degrees.
TITLES = "dr prof professor mr mrs ms miss sir dame ing dipl mag msc bsc phd mba md ba ma beng meng jr sr esq".split()
#: Particles that belong to a surname.
PARTICLES = "van von der den de del della di da dos du la le ter ten zu zum af av bin ibn al el".split()
#: Letters that normalisation doesn't take apart.
LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"})


def _table(text: str) -> dict[str, list[str]]:
    return {k: v.split(",") for k, v in (x.split(":") for x in text.split())}


_NICK = _table(NICKNAMES)
_LINE = {k: v[0] for k, v in _table(BUSINESS).items()}
_LINE |= {v: v for v in _LINE.values()} | {w: w for w in BUSINESS_WORDS.split()}
_LINE |= {"laboratory": "laboratories", "technology": "technologies", "solution": "solutions", "service": "services"}
_LINE |= {"system": "systems", "events": "event"}
#: Known lines of business, each by its full word.
BUSINESS_LINES = sorted({*_LINE.values()})
_LEGAL = set(LEGAL_FORMS.split())
_NOBODY = {x.strip() for x in NOBODY.replace("\n", "").split("|")}
_TITLES = set(TITLES)
_PARTICLES = set(PARTICLES)


def fold(text: str) -> str:
    """Lower case, without marks above or below letters."""
    text = unicodedata.normalize("NFKD", text.lower().translate(LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c))


def fold_given(name: str) -> str:
    """A folded given name in which ae, oe and ue count like the bare vowel."""
    name = fold(name)
    return re.sub(r"(?<=.)?([aou])e(?=[^aeiou])", r"\1", name) if len(name) > 3 else name


_NICK = {fold_given(k): [fold_given(x) for x in v] for k, v in _NICK.items()}
#: Known given names, formal and short.
KNOWN_GIVEN = sorted({*_NICK, *(x for v in _NICK.values() for x in v)})
_KNOWN = set(KNOWN_GIVEN)

_TAG = re.compile(r"<[^<>]*>")
_BRACKET = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]")
_QUOTED = re.compile(r"[\"“”„«»‘][^\"“”„«»‘’]{1,40}[\"“”„«»’]")
_DASH_TAIL = re.compile(r"\s+[–—-]\s+.*$")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-Z])")
_DOTTED = re.compile(r"^(?:\w\.)+\w?\.?$")
#: What a credit is made of: kind (person, org, bare: one word, handle: one lower-case word), family, given name or initial, its alternatives, middle initial, line, joined.
FIELDS = ("kind", "family", "given", "alternatives", "middle", "line", "joined")


def credit_text(text: str) -> str:
    """A credit without markup, entities and odd blanks."""
    text = html.unescape(html.unescape(_TAG.sub(" ", text)))
    return " ".join(unicodedata.normalize("NFC", text).split())


def _word(token: str) -> str:
    return re.sub(r"[^\w]+", "", fold(token))


def parse_credit(raw: str) -> tuple | None:
    """The parts of a credit, or None where it names nobody in particular."""
    text = credit_text(raw)
    plain = " ".join(re.findall(r"\w+", fold(text)))
    if not plain or plain in _NOBODY or not re.search(r"[^\W\d_]", plain):
        return None
    text = _QUOTED.sub(" ", _BRACKET.sub(" ", text))
    team = bool(re.search(r"[–—-]\s+.*\bteam\b", text, re.I))
    text = _DASH_TAIL.sub("", text).strip(" ,;:|/")
    text = re.sub(r"^(?:by|von|par|por)\s+(?=\S+\s)", "", text, flags=re.I)
    if re.match(r"^the\s.*\steam$", text, re.I) or re.match(r"^team\s|.*\steam$", text, re.I):
        team = True
        text = re.sub(r"^the\s+(?=.*\steam$)|^team\s+|\s+team$", "", text, flags=re.I)
        text = re.sub(r"\s+team$", "", text, flags=re.I)
    parts = [p.split() for p in text.split(",")]
    tokens = [t for p in parts for t in p]
    if len(tokens) == 1 and not _DOTTED.match(tokens[0]):
        split = _CAMEL.sub(" ", tokens[0]).split()
        if len(split) > 1 and any(_word(t) in _LINE for t in split[1:]):
            tokens, parts = split, [split]
        elif m := re.match(r"^(\w)\.(\w{2,})$", tokens[0]):
            tokens = [m[1] + ".", m[2]]
            parts = [tokens]
    words = [(t, _word(t)) for t in tokens]
    words = [(t, w) for t, w in words if w]
    lines = [w for _, w in words if w in _LINE]
    legal = [w for i, (t, w) in enumerate(words) if w in _LEGAL and i > 0]
    if lines or team or (legal and len(words) - len(legal) <= 2 and words[-1][1] in _LEGAL):
        stem = "".join(w for i, (_, w) in enumerate(words) if w not in _LINE and not (w in _LEGAL and i > 0) and w not in ("and", "the", "und", "et", "y"))
        if not stem:
            return None
        line = " ".join(sorted({_LINE[w] for w in lines}))
        return ("org", stem, None, [], None, line, stem) if line or not team else ("bare", stem, None, [], None, "", stem)
    if len(words) == 1:
        one = words[0][1]
        for w in sorted(_LINE, key=len, reverse=True):  # an organisation's name in one lower-case word
            full = _LINE[w]
            if one.endswith(w) and len(w) >= 5 and len(one) - len(w) >= 5 and w == full:
                rest, line = one[: -len(w)], {full}
                for v in sorted(_LINE, key=len, reverse=True):
                    if rest.endswith(v) and len(v) >= 3 and len(rest) - len(v) >= 5 and _LINE[v] == v:
                        rest, line = rest[: -len(v)], line | {v}
                        break
                return ("org", rest, None, [], None, " ".join(sorted(line)), rest)
        return ("handle" if tokens[0].islower() else "bare", one, None, [], None, "", one)
    first = [(t, _word(t)) for t in parts[0] if _word(t)]
    rest = [(t, _word(t)) for p in parts[1:] for t in p if _word(t) and _word(t) not in _TITLES]
    first = [x for x in first if x[1] not in _TITLES] or first
    if rest:
        surname, names = first, rest
    else:
        upper = [t.isupper() and len(w) > 1 for t, w in first]
        last_known = fold_given(first[-1][1]) in _KNOWN and fold_given(first[0][1]) not in _KNOWN and len(first[0][1]) > 1
        if len(first) > 1 and ((upper[0] and not all(len(w) == 1 or u for (_, w), u in zip(first[1:], upper[1:]))) or (last_known and len(first) == 2)):
            surname, names = first[:1], first[1:]
        else:
            cut = len(first) - 1
            while cut > 1 and first[cut - 1][1] in _PARTICLES:
                cut -= 1
            surname, names = first[cut:], first[:cut]
    if not surname or not names:
        one = "".join(w for _, w in first)
        return ("bare", one, None, [], None, "", one) if one else None
    family = " ".join(w for _, w in surname)
    given = names[0][1]
    middle = next((w for _, w in names[1:] if len(w) == 1), None) or next((w[0] for _, w in names[1:]), None)
    if len(given) > 1:
        given = fold_given(given)
    alternatives = _NICK.get(given, [])
    joined = given + family.replace(" ", "")
    return ("person", family, given, alternatives, middle, "", joined)

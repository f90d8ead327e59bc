"""Whether an answer declines to answer, by dictionaries of single words.

A clause declines if, within a few words, it speaks of oneself, denies, and names an
act of answering ("No voy a responder a eso"); if it speaks of oneself and of a
bar, with an act of answering, a denial or a second bar ("my guidelines prevent
me"); if it refuses outright ("I must pass"); or if it holds no word of its own
and denies an answer ("No answer can be given"). An answer is a refusal if some
clause declines and every other one does too, or is a courtesy, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from quern.llm.cuts import LEADING_ON
from quern.llm.language import FUNCTION_WORDS

#: Words by language and by what they do; a star stands for any ending.
#: ``self``: oneself; ``us``: oneself among others; ``deny``; ``answer``: acts of answering; ``give``: acts that
#: answer only with oneself alone; ``bar``, ``edge``: what forbids, what lies outside; ``answered``: an answer as a thing; ``polite``.
WORDS = {
    "en": {
        "self": "i me my mine myself", "us": "we us our ours", "deny": "not never cannot no nothing unable unwilling neither nor",
        "answer": "answer* help helping helps assist* discuss* talk* comment* respond* reply replying comply complying advise advice opinion opine speak* engage* weigh",
        "give": "say share sharing provide providing offer* disclose disclosing reveal* give giving go going continue fulfil* write generate touch get getting information details",
        "bar": "inappropriate uncomfortable policy policies guideline guidelines forbid* prohibit* prevent* restrict* allowed permitted authorised authorized unethical", "edge": "outside beyond against scope position comfortable rule rules boundaries remit",
        "answered": "answer answered discuss discussed comment comments disclosed",
        "polite": "sorry apolog* thank* hope understand* please unfortunately regret* regrettably afraid instead else appreciate glad happy pleasure kindly consult contact regards luck try",
    },
    "de": {
        "self": "ich mir mich mein*", "us": "wir uns unser*", "deny": "nicht kein* nichts nie niemals weder",
        "answer": "antwort* beantwort* helfen helfe hilf* behilflich weiterhelf* äußer* besprech* sprech* rede reden kommentier* kommentar* auskunft auskünfte stellung eingeh* einlass* einlasse unterstütz* berat* rat meinung diskutier* erörter* nachkomm* dienen",
        "give": "sag* gebe geben mache machen tun tue mitteil* verrat* preisgeb* weitergeb* behandel* schreib*",
        "bar": "erlaubt gestattet untersag* verbiet* verboten befugt berechtigt richtlini* vorgaben vorschrift* unangemessen unmöglich", "edge": "außerhalb jenseits regeln zuständig* gegen lage",
        "answered": "antwort auskunft kommentar kommentare beantwortet besprochen",
        "polite": "bitte danke dank leid leider entschuldig* hoffe verständnis verstehen verstehe bedau* gern gerne grüße gruß freundlich* sonst wenden tut",
    },
    "fr": {
        "self": "je j me m mon ma mes moi", "us": "nous notre nos", "deny": "ne n pas aucun* rien jamais non ni",
        "answer": "répon* réponse aid* assist* discut* parl* aborder commenter commentaire commentaires traiter conseill* avis exprimer prononcer évoquer",
        "give": "dire dis donner donne fournir faire fais partag* divulguer révéler satisfaire accéder étendre renseignement* information*",
        "bar": "interdi* empêch* autoris* impossible inapproprié* consigne consignes politique* habilit* permis permet*", "edge": "mesure cadre dehors delà règles sort dépasse hors périmètre",
        "answered": "réponse commentaire commentaires commenté* abordé* discuté*",
        "polite": "désolé* merci veuillez prie plaît espère compren* remerci* malheureusement regret* navré* volontiers puis bonne journée cordialement apprécie excus* consult* adress* pardon",
    },
    "es": {
        "self": "yo me mi mis mí puedo podré podría debo deberé quiero querría voy estoy prefiero preferiría tengo tendré soy haré diré daré respondo responderé contesto contestaré hablo hablaré ayudaré opino doy digo", "us": "nos nuestr* podemos debemos queremos vamos estamos somos tenemos",
        "deny": "no nunca jamás nada ningun* ningún tampoco ni",
        "answer": "respond* respuesta respuestas contest* ayud* habl* trat* opin* coment* conversar debat* discut* asesor* aconsej* atend* pronunci* abord* asist*",
        "give": "dar doy daré decir digo diré hacer hago haré compart* revel* ofrec* entrar proporcion* facilit*",
        "bar": "prohíb* prohib* impid* imped* autorizad* permitid* permite* normas directrices política* inapropiad* imposible posible", "edge": "fuera alcance reglas ámbito condiciones",
        "answered": "respuesta comentario comentarios responder comentar",
        "polite": "siento lamento gracias agradezc* favor espero entiend* comprend* desgracia lamentablemente desgraciadamente perdon* disculp* saludos consult* gusto",
    },
}
#: Refusals of more than one word, as patterns over words with single blanks.
OUTRIGHT = [
    r"\bi (?:\w+ ){0,4}(?:decline|refuse|abstain)\b", r"\b(?:i|we) (?:\w+ ){0,3}(?:have|need|going|must|will|want|choose) (?:to )?pass\b", r"\b(?:stay|steer|keep) (?:\w+ )?(?:away|clear|out)\b", r"\boff limits\b", r"\bask (?:someone|somebody) else\b", r"\brather not\b", r"\bprefer not\b", r"\bno comment\b", r"\bnot something i\b", r"\bi (?:can|will|could|ca|wo)(?: not|not) (?:possibly )?do (?:that|this|so|it)\b",
    r"\bich (?:\w+ ){0,5}(?:ablehnen|verweiger\w*|weiger\w*|passen|enthalte|verzichte\w*|heraus|raus)\b", r"\blehne ich (?:\w+ ){0,4}ab\b", r"\bich lehne (?:\w+ ){0,6}ab\b", r"\b(?:enthalte|weigere) ich mich\b", r"\bhalte ich mich (?:\w+ ){0,2}(?:heraus|raus|zurück)\b", r"\bkein kommentar\b",
    r"\b(?:je|j|me|m) (?:\w+ ){0,4}(?:refuse|refuser|décline|décliner|abstiens|abstenir)\b", r"\bje (?:\w+ ){0,2}passe(?:r)?(?: mon tour)?$", r"\bpréfère ne pas\b", r"\b(?:aucun|pas de) commentaire\b",
    r"\b(?:rechazo|declino|rechazarla|rechazarlo)\b", r"\b(?:debo|tengo que|voy a|prefiero) (?:rechazar|declinar|pasar)\b", r"\bme abstengo\b", r"\babstenerme\b", r"\bme niego\b", r"\bprefiero no\b", r"\bpreferiría no\b", r"\bsin comentarios\b",
]
#: Words of which each of those patterns has one.
OUTRIGHT_WORDS = "decline refuse abstain pass away clear out off else rather prefer comment something do ab ablehnen verweiger* weiger* passen enthalte verzichte* heraus raus zurück kommentar refuser décliner décline abstiens abstenir passe passer préfère commentaire rechaz* declin* pasar abstengo abstenerme niego prefiero preferiría comentarios"
#: Words without a subject of their own, besides the function words.
VAGUE = (
    "let lets something anything nothing another other topic topics subject question questions request matter here you your can could may might will would do doing does be been am so very really just today any there one ones given made possible specialist professional expert person asking ask s ll d ve re t ca wo "
    "frage fragen anfrage thema themen sache hier dies diese dieser diesem dieses dazu dabei darüber darauf darf sie ihnen ihr ihre etwas anderes andere eine fachperson fachleute mehr möchte muss will werde wurde gegeben als assistent "
    "question questions demande sujet sujets chose ici cela ça vous votre vos autre autres quelqu spécialiste suis peux puis ai dois veux souhaite peut être en tant assistant d c s qu y "
    "pregunta petición tema temas cosa aquí eso usted te le les otra otro algo especialista puede ser puedo hacer como asistente se "
    "assistant ai language model"
).split()
#: Words between what must stand together, and words of its own that a courtesy or an opening may have.
NEAR, POLITE_OTHERS, OPENING = 8, 2, 3
WORD_LIMIT = 200_000

_KINDS = ("self", "us", "deny", "answer", "give", "bar", "edge", "answered", "polite")
_BITS = {(lang, kind): 1 << (k * len(_KINDS) + j) for k, lang in enumerate(WORDS) for j, kind in enumerate(_KINDS)}
_KNOWN = 1 << (len(WORDS) * len(_KINDS))
_MATCH = {bit: re.compile("|".join(w.replace("*", r"\w*") for w in WORDS[lang][kind].split())).fullmatch for (lang, kind), bit in _BITS.items()}
_STARTS = _KNOWN << 1
_STARTING = re.compile("|".join(w.replace("*", r"\w*") for w in OUTRIGHT_WORDS.split())).fullmatch
_PLAIN = frozenset(VAGUE).union(*FUNCTION_WORDS.values(), *LEADING_ON.values())
_POLITE = sum(bit for (_, kind), bit in _BITS.items() if kind == "polite")
_FORBIDS = sum(bit for (_, kind), bit in _BITS.items() if kind in ("deny", "bar", "edge"))
_SPEAKS = sum(bit for (_, kind), bit in _BITS.items() if kind in ("self", "us", "answered"))
_MAY_REFUSE = _POLITE | _STARTS | _FORBIDS
_SENTENCES = re.compile(r"[.!?]\s+|\n+")
_CLAUSES = re.compile(r"[;:()]|\s[–—-]\s|,?\s+(?:but|however|although|though|aber|doch|jedoch|sondern|mais|cependant|toutefois|pourtant|pero|sino|aunque)\s+")
_QUOTED = re.compile(r"\"[^\"]*\"|«[^»]*»|„[^“”]*[“”]|“[^”]*”")
_NOT = re.compile(r"n't\b")
_PAST = re.compile(r"\b(?:did|was|were) not\b")
_TOKENS = re.compile(r"[^\W\d_]+").findall
_OUTRIGHT = re.compile("|".join(OUTRIGHT)).search
_known: dict[str, int] = {}
#: Of the words in ``_known``, those that a clause that declines or is polite has.
_telling: set[str] = set()


def _mask(word: str) -> int:
    """What a word does, a bit for each language and kind."""
    mask = _known.get(word)
    if mask is None:
        if len(_known) > WORD_LIMIT:
            _known.clear()
            _telling.clear()
        mask = sum(bit for bit, match in _MATCH.items() if match(word))
        mask |= (_KNOWN if mask or word in _PLAIN else 0) | (_STARTS if _STARTING(word) or word == "t" else 0)
        _known[word] = mask
        if mask & _MAY_REFUSE:
            _telling.add(word)
    return mask


def _may_refuse(words: list[str]) -> bool:
    """Whether there are words of all the kinds that a clause that declines, or those that one that is polite has."""
    if _known.keys() >= set(words) and _telling.isdisjoint(words):
        return False
    held = 0
    for w in words:
        held |= _mask(w)
    return bool(held & (_POLITE | _STARTS) or held & _FORBIDS and held & _SPEAKS)


def sentences(text: str) -> Iterator[str]:
    """One sentence after the other, none found before it is asked for."""
    start = 0
    for gap in _SENTENCES.finditer(text):
        yield text[start : gap.start() + (text[gap.start()] != "\n")]
        start = gap.end()
    yield text[start:]


def clauses(sentence: str) -> Iterator[list[str]]:
    """The words of each clause, in lower case, without what is quoted; ``not`` stands alone."""
    own = _QUOTED.sub(" ", sentence.replace("’", "'").lower().strip(" \t\"'*_>`“”«»"))
    own = _PAST.sub(" ", _NOT.sub(" not", own))
    for part in _CLAUSES.split(own):
        words = _TOKENS(part)
        if words:
            yield words


def _near(masks: list[int], *kinds: int) -> bool:
    """Whether some stretch of ``NEAR`` words has all the kinds."""
    places = [[k for k, m in enumerate(masks) if m & kind] for kind in kinds]
    if not all(places):
        return False
    if len(masks) <= NEAR:
        return True
    return any(all(any(0 <= k - first < NEAR for k in own) for own in places) for first in range(len(masks)))


def declines(words: list[str]) -> bool:
    """Whether a clause refuses to answer."""
    masks = [_mask(w) for w in words]
    held = 0
    for m in masks:
        held |= m
    if held & _STARTS and _OUTRIGHT(" ".join(words)):
        return True
    if not held & _FORBIDS:
        return False
    for lang in WORDS:
        one, us, deny, answer, give, bar, edge, answered, _ = (_BITS[lang, kind] for kind in _KINDS)
        if held & (one | us):
            if held & deny and (held & answer and _near(masks, one | us, deny, answer) or held & give and _near(masks, one, deny, give)):
                return True
            bars = sum([bool(m & (bar | edge)) for m in masks]) if held & (bar | edge) else 0
            if bars and (bars > 1 and held & bar or held & (answer | give) or held & deny and held & bar):
                return True
        if held & deny and held & answered and all(m & _KNOWN for m in masks):
            return True
    return False


def is_courtesy(words: list[str]) -> bool:
    """Whether a clause only apologizes, thanks, wishes or sends on, or has no word of its own."""
    masks = [_mask(w) for w in words]
    others = sum(not m & _KNOWN for m in masks)
    return not others or others <= POLITE_OTHERS and any(m & _POLITE for m in masks)


def is_refusal(answer: str) -> bool:
    """Whether some clause declines and each other one does too or is a courtesy; a few words may come first.

    The first clause that does neither ends the search, so a long answer costs little.
    """
    refused = False
    for sentence in sentences(answer):
        if not refused:
            words = _TOKENS(sentence.lower())
            if not _may_refuse(words):  # it neither declines nor is polite; what says nothing of its own opens no refusal either
                if len(words) > OPENING:
                    return False
                continue
        for words in clauses(sentence):
            if declines(words):
                refused = True
            elif not is_courtesy(words) and (refused or len(words) > OPENING):
                return False
    return refused

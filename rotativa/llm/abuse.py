"""Abusive, hateful or sexual content (problem 10).

All passages, each once, are put to many voters - lexicons and patterns for
insults, threats, degradation of groups and sexual content, and for the reports,
lessons and harmless uses that share their words.  A generative label model
estimates by EM how accurate each voter is and which of them repeat each other,
and turns their votes into the probability of a passage being abusive.  On these
and on the labelled samples a linear classifier of words and word pairs is
trained in shards, whose weights are averaged; it scores every passage of every document, and a document by its worst.

Words and word pairs are hashed to a fixed number of buckets, so that the model
has a size that doesn't grow with the documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import keep

#: At most so many labelled samples are used.
LABELLED = 20_000
#: Distinct passages of one shard, about; every passage is in one.
SHARD = 60_000
#: Score from which a document counts as a case.
THRESHOLD = 0.5
#: No token speaks against abuse more than this.
AGAINST = -2.0
#: Buckets of words and word pairs, as a power of two.
BUCKETS = 21

#: Latin-1 bytes to lower case without accents.
_PLAIN = bytes(
    ord(unicodedata.normalize("NFKD", chr(i))[0].lower()) if chr(i).isalpha() and ord(unicodedata.normalize("NFKD", chr(i))[0].lower()) < 128 else i for i in range(256)
)
_LATIN = re.compile(r"[\x00-\xff–—‘’“”…€™•]*")
# Cyrillic and Greek letters that look like Latin ones.
_ALIKE_LETTERS = str.maketrans("аеорсухіјѕԁһвкмнтАЕОРСХІЈЅВКМНТαορνυιτκ", "aeopcyxijsdhbkmhtAEOPCXIJSBKMHTaopvuitk")
_LEET = str.maketrans("013457@$!", "oieastasi")
_SPELT = re.compile(r"\b(?:[a-z][.*_\- ]{1,2}){3,}[a-z]\b")
_SPELT_HINT = re.compile(r"(?<![a-z])[a-z][.*_\- ]{1,2}[a-z][.*_\- ]{1,2}[a-z][.*_\- ]")
_MIX_HINT = re.compile(r"[a-z][0-9@$]|[0-9@$][a-z]")
_INNER = re.compile(r"(?<=[a-z])[*](?=[a-z])")
_MIXED = re.compile(r"(?<![\w#])(?=[a-z0-9@$]*[a-z])(?=[a-z0-9@$]*[0-9@$])[a-z0-9@$]{3,}(?![\w])")
_LONG = re.compile(r"([a-z])\1{2,}")
_USER = re.compile(r"^[ \t]*(?:@[\w.]+ ?:|>+)[ \t]*", re.M)
_SENTENCE = re.compile(r"(?<=[.!?;])[»\"]?\s+")
_QUOTED = re.compile(r"«[^»]{0,400}»|\"[^\"]{0,400}\"")
_REPORTS = re.compile(r"[,:]? ?(?:\w+ )?(?:dijo|relato|declaro|senalo|afirmo|comento|explico|indico|sostuvo|aseguro|advirtio|said|told|disse|grit\w+|escribio|se leia|publico)\b|^.{0,60}\b(?:llamad[oa]|llamar\w*|palabras?|espectaculo|frases?|titulad[oa]|insulto)\b")
_TOKEN = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d[\d,.]*")


def plain(text: str) -> str:
    """Lower case without accents."""
    if "“" in text or "”" in text:
        text = text.replace("“", '"').replace("”", '"')
    if not text.isascii() and not _LATIN.fullmatch(text):
        # letters beyond Latin-1 lose their marks, look-alikes of other scripts become the letters they pass for
        text = "".join(c for c in unicodedata.normalize("NFKD", text).translate(_ALIKE_LETTERS) if not unicodedata.combining(c))
    return text.encode("latin-1", "replace").translate(_PLAIN).decode("latin-1")


def undisguised(t: str) -> str:
    """A plain text with disguised spellings undone."""
    if _SPELT_HINT.search(t):
        t = _SPELT.sub(_join, t)
    if "*" in t:
        t = _INNER.sub("", t)
    if _MIX_HINT.search(t):
        t = _MIXED.sub(_unleet, t)
    return _LONG.sub(r"\1", t)


def disguises(t: str) -> bool:
    """Whether a plain text may hold a disguised spelling; where not, ``undisguised`` changes nothing."""
    return "*" in t or bool(_MIX_HINT.search(t) or _LONG.search(t) or _SPELT_HINT.search(t))


#: What every disguised spelling has, for a reader that is fast and sees many texts at once.
_HINTS = r"[a-z][0-9@$]|[0-9@$][a-z]|\*|(?:^|[^a-z])[a-z][.*_\- ]{1,2}[a-z][.*_\- ]{1,2}[a-z][.*_\- ]|" + "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")


def undisguise(texts: Sequence[list[str]]) -> list[list[str]]:
    """For each list of plain passages those that held a disguised spelling, undone."""
    joined = pa.array(["\n".join(ps) for ps in texts], pa.large_string())
    hinted = pc.match_substring_regex(joined, _HINTS).to_numpy(zero_copy_only=False)
    return [[undisguised(p) for p in ps if disguises(p)] if hint else [] for ps, hint in zip(texts, hinted)]


def normal(text: str) -> str:
    """Lower case without accents, with disguised spellings undone."""
    return undisguised(plain(text))


def _join(m: re.Match[str]) -> str:
    return re.sub(r"[.*_\- ]", "", m[0])


def _unleet(m: re.Match[str]) -> str:
    return m[0].translate(_LEET)


def own_voice(sentence: str) -> str:
    """A normal passage without what it only quotes in a report."""
    if "«" not in sentence and '"' not in sentence:
        return sentence
    rest = _QUOTED.sub(" ", sentence)
    return rest if _REPORTS.search(rest) else sentence


def _plain_passages(text: str | None) -> list[str]:
    """Plain sentences of a text in its own voice, without the names of those who comment."""
    if not text:
        return []
    t = plain(text)
    if "@" in t or ">" in t:
        t = _USER.sub("", t)
    return [own_voice(s) for line in t.split("\n") if line and not line.isspace() for s in _SENTENCE.split(line) if s]


def passages(text: str | None) -> list[str]:
    """The same with disguised spellings undone."""
    return list(map(undisguised, _plain_passages(text)))


# General lexicons of the voters in Spanish, English and Portuguese, in the form of ``normal``; stems stand for all their endings.
_INSULT = (
    r"(?:pendej|estupid|idiot|imbecil|cretin|tarad|inutil|infeli[zc]|payas|cabron|babos|mugros|maldit|lacra|escoria|gusan|culer|mamon|mens[oa]|tont[oa]|brut[oa]|burr[oa]|besti|cerd[oa]|puerc|cochin|asqueros|miserabl|"
    r"desgraciad|malparid|zorra|perra|marica|joto|ratero|ladron|corrupt|vendid|lambiscon|arrastrad|mantenid|basura|ignorant|moron|loser|scum|worthless|filth|pathetic|bastard|bitch|asshole|jerk|dumb|stupid|trash|garbage|coward|otari|nojent|imund|vagabund|lixo|verme)\w*"
)
_STRONG = r"(?:pendej|imbecil|cretin|tarad|cabron|babos|malparid|culer|pinche|moron|scum|bastard|bitch|asshole|otari|nojent)\w*"
_YOU = r"\b(?:eres|tu|te|ti|contigo|vos|sos|usted|ustedes|you|your|yourself|voce|voces|seu|sua)\b"
_PEOPLE = r"[a-z]{4,}(?:ecos?|ecas?|inos?|inas?|enos?|enas?|ense?s?|anos?|anas?|amos?|amas?|quiramos?|tes|ans|ians)"
_ALL = r"\b(?:los|las|unos|esos|esas|estos|estas|todos|ningun|ninguna|un|una|those|these|all|every|a|os|as|esses|essas)\b"
_VERMIN = r"\b(?:plagas?|pragas?|vermin|ratas?|rats?|cucarachas?|cockroach\w*|parasit\w*|conejos|animales|animals|bestias|monos|simios|apes|infrahuman\w*|subhuman\w*|sabandijas?|alimanas?|escoria|lacras?|basura|scum|pests?|peste|cancer)\b"
_DRIVE = r"(?:ech[aeo]|expuls|sac[aou]|saqu|correrl|corranl|larg|barr(?:er|an|amos|emos)|limpi|vaci|quem|mata|maten|extermin|ahorc|colg|linch|golpe|deport|arr?astr|marcarl|throw|thrown|kick|shoot|shot|kill|hang|burn|wip)\w*"

VOTERS: tuple[tuple[str, int, re.Pattern[str]], ...] = tuple(
    (n, v, re.compile(p))
    for n, v, p in (
        # insults
        ("insult_to_you", 1, rf"{_YOU}.{{0,30}}\b{_INSULT}|\b{_INSULT}.{{0,30}}{_YOU}"),
        ("insult_called", 1, rf"\b(?:pinches?|maldit[oa]s?|bola de|hij[oa]s? de|pedazo de|partida de|familia de|este|esta|est[oa]s|esos|seu|sua|damn|fucking|filthy|you)\s(?:\w+\s)?{_INSULT}"),
        ("insult_comma", 1, rf",\s?(?:\w+\s)?{_INSULT}\s*(?:[,.!]|$)"),
        ("insult_strong", 1, rf"\b{_STRONG}"),
        ("insult_cry", 1, rf"\b(?:que|so|such an?|how)\s{_INSULT}"),
        ("begone", 1, r"\b(?:callate|callense|largate|larguense|vete|vayanse|fuera|shut up|get lost|get out|go away|go back|cala a boca|some daqui|saia daqui)\b"),
        ("disgust", 1, r"\b(?:asco|verguenza|repugn\w+|asquea\w*|lastima|disgust\w*|shame|nojo|vergonha)\b"),
        ("profane", 1, r"\b(?:mierda|chinga\w*|verga|put[oa]s?|joder|carajo|porqueria|cagad\w+|fuck\w*|shit\w*|merda|caralho|porra)\b"),
        ("no_worth", 1, rf"{_YOU}.{{0,40}}\b(?:sirv\w+|val[eg]\w*|merec\w+|derecho|deserve|worth|right to|presta)\b|\bno (?:sirves|vales|mereces)\b|\bpara (?:otra|nada|nadie)\b"),
        ("nobody", 1, r"\b(?:nadie|nobody|no one|everybody|todos?|ninguem)\b.{0,20}\b(?:te|you|odian?|hates?|aguant\w+|quiere|soport\w+|aguenta|miss|llor\w+|extran\w+)\b"),
        # threats
        ("threat_body", 1, r"\b(?:te|les|los|las|lo|la|you|your|a)\b.{0,20}\b(?:rompo|romper\w*|parto|partir\w*|mato|matar\w*|madre\w*|golpe\w*|revent\w+|quebr\w+|arrastr\w+|break|smash|kill|crush|hurt|palizas?|cara|face|pelos|dientes|huesos)\b"),
        ("death_wish", 1, r"\b(?:ojala|espero|hope|tomara|deseo|que se|merec\w+|deserv\w+)\b.{0,50}\b(?:muer\w+|mor[ir]\w+|mat\w+|atropell\w+|quem\w+|pudr\w+|cancer|ahog\w+|die|dead|suffer|rot|burn|lo peor|lo malo|desaparec\w+)\b"),
        ("vanish", 1, r"\b(?:desaparec\w+|muerete|matate|kill yourself|drop dead|ahorra\w+|ahorc\w+|suicid\w+)\b"),
        ("threat_watch", 1, r"\b(?:se|sabemos|sab[eio]\w*|i know|we know|vi|vimos)\b.{0,16}\b(?:donde|where|onde|hora|when)\b.{0,16}\b(?:vives?|trabajas?|sales?|llegas?|live|work|leave|mora)\b|\b(?:cuid\w+|watch|watching)\b.{0,16}\b(?:espalda|back)\b|\bya veras\b|\b(?:te|you).{0,12}(?:arrepent\w+|quej\w+|regret)\b"),
        ("force", 1, rf"\b(?:habria|hay|deben?|deberian?|merecen?|should|must|ought|deviam|devem|vamos a|voy a|van a)\b.{{0,25}}\b{_DRIVE}"),
        ("deserve", 1, r"\b(?:merec\w+|deserv\w+)\b.{0,25}\b(?:palizas?|golpiza|golpes|madriza|cachetada|castigo|morir|lo peor|lo que|beating|death)\b"),
        # groups
        ("group_cleanse", 1, rf"\b(?:limpi|barrer|barramos|vaci|saqu|saca|libr|clean|rid)\w*\b.{{0,40}}\b(?:de|of)\s(?:los\s|the\s)?{_PEOPLE}\b"),
        ("group_vermin", 1, rf"{_ALL} (?:\w+ )?{_PEOPLE}\b.{{0,60}}{_VERMIN}"),
        ("vermin_likened", 1, rf"\b(?:son|sao|are|is|es|eran|como|like|unos|unas)\s(?:\w+\s){{0,2}}{_VERMIN}"),
        ("group_all", 1, rf"{_ALL} (?:\w+ )?{_PEOPLE}\s(?:\w+\s){{0,3}}\b(?:son|are|sao|solo|solamente|only|nunca|never|siempre|always|sirven|entienden|viven|roban|mienten|deben|should|deviam|no)\b"),
        ("group_inferior", 1, rf"{_PEOPLE}\b.{{0,50}}\b(?:inferior\w*|raza|sangre|gente|human[oa]?s?|delincuentes|criminals?|ladrones|flojos|sucios|mentira|blood|race)\b|\braza de\b"),
        ("group_out", 1, rf"\b(?:fuera|malditos?|malditas?|larguense|muerte a|death to|out with|abajo)\b.{{0,30}}{_PEOPLE}|{_PEOPLE}.{{0,40}}\b{_DRIVE}|\b{_DRIVE}.{{0,40}}\b(?:de|a|los|las|the|os)\s{_PEOPLE}"),
        ("group_keep_off", 1, rf"\b(?:no|never|nunca|nadie|quien|who)\b.{{0,30}}\b(?:quiero|contrat\w+|dej\w+|let|dar\w*|want|hire|dialog\w+|habl\w+)\b.{{0,40}}{_PEOPLE}|\bcon {_ALL[2:]} {_PEOPLE} no\b"),
        ("group_blame", 1, rf"\b(?:culpa|abuelos|comprobado|blame|saben?|sabian)\b.{{0,40}}{_ALL} {_PEOPLE}"),
        # sexual content
        ("sex_words", 1, r"\b(?:porno\w*|x|nudes?|escorts?|tetas?|culos?|cog(?:er|ida|iendo)\w*|foll\w+|lam(?:er|io|iendo)\w*|chup\w+|mamad\w+|polla|penetr\w+|orgasm\w+|gem\w+|gim\w+|excita\w+|horny|erotic[oa]s?|lenceria|tangas?|masturb\w+|blowjob|cum|putas?|sexo|sexy|moan\w*)\b"),
        ("sex_bare", 1, r"\b(?:desnud[oa]s?|desvest\w+|sin ropa|naked|nude|undress\w*|bra|panties|calzon\w*|nuas?|nus|pelad[oa]s)\b"),
        ("sex_heat", 1, r"\b(?:calient\w+|ardient\w+|hot|sin censura|uncensored|intim[oa]s?|placer|pleasure|prazer|seduc\w+|tocand\w+|sin compromiso|madur[oa]s|solter[oa]s|swinger\w*|intercambi\w+)\b"),
        ("sex_scene", 1, r"\b(?:piernas|muslos|pechos|senos|cama|falda|blusa|ropa|pared|cuarto|boca|cuerpo|piel|thighs?|breasts?|bed|clothes|pernas)\b.{0,60}\b(?:entre|quit\w+|arranc\w+|le baj\w+|met\w+|lam\w+|bes\w+|acarici\w+|desabroch\w+|pedia|beg\w+|dese\w+|noche|imagin\w+)\b|\b(?:quit\w+|arranc\w+|le baj\w+|met\w+|lam\w+|bes\w+|acarici\w+|desabroch\w+|imagin\w+|beg\w+)\b.{0,60}\b(?:piernas|muslos|pechos|senos|cama|falda|blusa|ropa|pared|cuarto|cuerpo|piel|thighs?|breasts?|bed|clothes)\b"),
        ("sex_offer", 1, r"\b(?:masajes?|chicas|modelos|packs?|fotos|videos?|canal|parejas|fiesta|encuentros?|girls|women|mulheres|garotas|adult[oa]s)\b.{0,60}\b(?:calient\w+|ardient\w+|desnud\w+|intim\w+|nudes|x|censura|adult\w+|hot|naked|nuas|live|vivo|gratis|paga|enlace|link|horas|compromiso|ropa)\b"),
        # reports, lessons, harmless uses
        ("court", -1, r"\b(?:juez|jueza|sentencia|fiscalia|carpeta|victimas?|detenid[oa]s?|denunci\w+|acoso|agresor\w*|sindicato|acus\w+|sancion\w*|discrimin\w+|expuls(?:o|ado)|judge|court|police|charged|tribunal|policia)\b"),
        ("lesson", -1, r"\b(?:escuelas?|educacion|taller\w*|campanas?|ensena\w*|medic[oa]s?|sintomas|clinicas?|anticoncep\w+|transmision|diccionario|palabra|origen|informe|documento|documental|retrata|exposicion|oleo|museo|libro|novela|school|health|education|saude|escola)\b"),
        ("science", -1, r"\b(?:ensayo|laboratorio|biolog[oa]s?|crias?|cachorros|albergue|alcantarillas?|veneno|mercado|receta|guisos?|cociner[oa]s?|zoologico|especies?|granja|study|species)\b"),
        ("show", -1, r"\b(?:comediante|espectaculo|teatro|obra|estreno|publico|funcion|arbitro|jugador\w*|estadio|torneo|partido|goles?|equipo)\b"),
        ("reported", -1, r"\b(?:segun|de acuerdo con|por haber|lament\w+|disculp\w+|relat\w+|consta|explic\w+|anunci\w+|inform\w+|coment\w+|asegur\w+|declar\w+|sostuv\w+|dijo|indic\w+|senal\w+|afirm\w+|said|according|disse)\b"),
        ("figures", -1, r"\b\d[\d,.]* (?:por ciento|millones|mil|pesos|familias|viviendas|vehiculos|expedientes|toneladas|empleos|meses|anos|semanas|dias|horas|noches|kilometros|votos|comercios|percent|million|years)\b"),
        ("civic", -1, r"\b(?:gobierno|municipi\w+|alcalde\w*|gobernador\w*|cabildo|diputad\w+|diputacion|comision|secretaria|empresa|hospital|universidad|red|cooperativa|council|board|agency|camara|congreso|consejo|instituto|conselho|agencia|union|patronato)\b"),
        ("polite", -1, r"\b(?:gracias|excelente|saludos|felicidades|buena|respeto|ojala que|por favor|thanks|please|obrigad[oa])\b"),
        ("plain", -1, r"\b(?:calendario|boletin|reunion|convenio|proyecto|lluvias?|contrato|precios?|protestas|trimestre|quarter|budget|orcamento|presupuesto|obras?|agua|vecin[oa]s|temporada|programa)\b"),
    )
)


#: Characters of which RE2 and ``re`` think alike.
_ALIKE = re.compile(r"[\t\r -~«»¿¡]*")


def votes(sentences: Sequence[str]) -> np.ndarray:
    """Votes on normal passages: one row per passage, one column per voter: 1 abusive, -1 not, 0 no opinion."""
    out = np.zeros((len(sentences), len(VOTERS)), np.int8)
    alike = [i for i, t in enumerate(sentences) if _ALIKE.fullmatch(t)]
    column = pa.array([sentences[i] for i in alike], pa.string())
    for j, (_, v, p) in enumerate(VOTERS):
        out[alike, j] = np.where(pc.match_substring_regex(column, p.pattern).to_numpy(zero_copy_only=False), v, 0)
    for i in sorted(set(range(len(sentences))).difference(alike)):
        out[i] = [v if p.search(sentences[i]) else 0 for _, v, p in VOTERS]
    return out


def _packed(v: np.ndarray) -> np.ndarray:
    """One number per row of votes: the voters that fired."""
    return (v != 0).astype(np.int64) @ (1 << np.arange(len(VOTERS), dtype=np.int64))


def _unpacked(fired: Sequence[int]) -> np.ndarray:
    on = np.array(fired, np.int64).reshape(-1, 1) >> np.arange(len(VOTERS)) & 1
    return (on * [v for _, v, _ in VOTERS]).astype(np.int8)


class LabelModel:
    """Accuracies and correlations of voters, by EM over their votes.

    Every voter votes one way or not at all; P(vote | class) is learnt for both
    classes.  Labelled rows keep their label and anchor the classes.  Pairs of
    voters that fire together more than their class explains are correlated;
    a voter's evidence is divided by one plus its correlations.
    """

    def __init__(self, rounds: int = 25):
        self.rounds = rounds

    def fit(self, v: np.ndarray, known: np.ndarray | None = None, count: np.ndarray | None = None) -> LabelModel:
        """Learn from rows of votes, each of which stands ``count`` times."""
        fired = (v != 0).astype(float)
        count = np.ones(len(v)) if count is None else count
        side = np.sign(count @ v) if len(v) else np.zeros(v.shape[1])
        known = np.full(len(v), -1.0) if known is None else known
        fixed = known >= 0
        up, down = (v > 0).sum(1), (v < 0).sum(1)
        post = np.where(fixed, known, 1 / (1 + np.exp(-np.clip(4 * up - 3 * down - 2, -30, 30))))
        self.weight = np.ones(v.shape[1])
        for _ in range(self.rounds):
            n1, n0 = count @ post + 2, count @ (1 - post) + 2
            p1 = (fired.T @ (count * post) + 0.1) / (n1 + 0.2)
            p0 = (fired.T @ (count * (1 - post)) + 0.1) / (n0 + 0.2)
            # a voter for abuse isn't taken to speak against it, nor the reverse
            p1, p0 = np.where(side >= 0, np.maximum(p1, p0), p1), np.where(side < 0, np.maximum(p0, p1), p0)
            on = np.log(p1 / p0)
            off = np.log((1 - p1) / (1 - p0)).clip(-0.5, 0.5) * 0.2
            resid = fired - post[:, None] * p1 - (1 - post[:, None]) * p0
            c = resid.T @ (count[:, None] * resid)
            d = np.sqrt(np.maximum(np.diag(c), 1e-9))
            corr = np.maximum(c / d[:, None] / d[None, :], 0)
            np.fill_diagonal(corr, 0)
            corr[corr < 0.2] = 0
            self.correlation, self.weight = corr, 1 / (1 + corr.sum(1) / 2)
            prior = np.log(n1 / n0)
            z = prior + (fired * self.weight) @ on + ((1 - fired) * self.weight) @ off
            post = np.where(fixed, known, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        self.on, self.off, self.prior, self.p1, self.p0 = on, off, prior, p1, p0
        self.posterior = post
        return self

    def predict(self, v: np.ndarray) -> np.ndarray:
        fired = (v != 0).astype(float)
        z = self.prior + (fired * self.weight) @ self.on + ((1 - fired) * self.weight) @ self.off
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Words, and the end of a passage.
_WORDS = re.compile(r"[a-z]+|\n")
_MASK = np.uint64((1 << BUCKETS) - 1)


class Hashing(dict):
    """Hashes of words; 0 for the end of a passage, 1 for letters that carry no weight."""

    def __missing__(self, word: str) -> int:
        if word == "\n":
            x = 0
        elif len(word) == 1 and word not in "xq":
            x = 1
        else:
            x = xxhash.xxh3_64_intdigest("que" if word == "q" else word) | 2
        if len(self) < 1_000_000:
            self[word] = x
        return x


_hashes = Hashing()


def features(passages: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, size): the buckets of the words and word pairs of normal passages, and how many each passage has."""
    n = len(passages)
    found = _WORDS.findall("\n".join(p.replace("\n", " ") for p in passages))
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    row = np.cumsum(h == 0, dtype=np.int32)
    words = h > 1
    row, h = row[words], h[words]
    pair = row[1:] == row[:-1]
    both = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))[pair]
    row = np.concatenate([row, row[1:][pair]])
    h = np.concatenate([h, both])
    h ^= h >> np.uint64(31)
    return row, (h * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(20) & _MASK).astype(np.int64), np.bincount(row, minlength=n)


def train(sentences: Sequence[str], target: np.ndarray, importance: np.ndarray, rounds: int = 40, ridge: float = 0.02) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Logistic regression on soft labels: (buckets, weights, bias, occurrences by bucket).

    Accelerated gradient steps of a length of its own for each bucket, which
    the passages that have it bound.
    """
    r, bucket, size = features(sentences)
    there = np.zeros(1 << BUCKETS, bool)
    there[bucket] = True
    names = np.flatnonzero(there)
    c = (np.cumsum(there) - 1)[bucket]
    n, m = len(sentences), len(names)
    x = 1 / np.sqrt(size[r])
    total = max(float(importance.sum()), 1e-9)
    spread = importance * (np.bincount(r, x, minlength=n) + 1)
    step = 0.25 * np.bincount(c, spread[r] * x, minlength=m) / total + ridge / total
    bias_step = max(0.25 * float(spread.sum()) / total, 1e-9)
    w, b, k = np.zeros(m), -2.0, 1.0
    at_w, at_b = w, b
    for _ in range(rounds):
        z = np.bincount(r, at_w[c] * x, minlength=n) + at_b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * importance / total
        g = np.bincount(c, e[r] * x, minlength=m) + ridge * at_w / total
        new_w, new_b = np.maximum(at_w - g / step, AGAINST), at_b - e.sum() / bias_step
        k, ahead = (1 + (1 + 4 * k * k) ** 0.5) / 2, k - 1
        at_w, at_b = new_w + ahead / k * (new_w - w), new_b + ahead / k * (new_b - b)
        w, b = new_w, new_b
    return names, w, float(b), np.bincount(c, minlength=m)


class Model:
    """The trained classifier: scores passages and documents."""

    def __init__(self, buckets: np.ndarray | Sequence[int] = (), weights: np.ndarray | Sequence[float] = (), bias: float = -5.0):
        self.weights = np.zeros(1 << BUCKETS, np.float32)
        self.weights[np.asarray(buckets, np.int64)] = np.asarray(weights, np.float32)
        self.bias = bias

    def _sums(self, passages: Sequence[str]) -> np.ndarray:
        row, bucket, size = features(passages)
        return np.bincount(row, self.weights[bucket], minlength=len(passages)) / np.sqrt(np.maximum(size, 1))

    def passage(self, sentence: str) -> float:
        """Probability that a passage is abusive; as ``document``."""
        return self.document(sentence)

    def document(self, text: str | None) -> float:
        """Score of a text: that of its worst passage, as it stands or with disguised spellings undone; 0 without any."""
        return float(self.documents([text])[0])

    def documents(self, texts: Sequence[str | None]) -> np.ndarray:
        """Scores of texts."""
        own = [_plain_passages(t) for t in texts]
        every = [ps + more for ps, more in zip(own, undisguise(own))]
        found = [p for ps in every for p in ps]
        owner = np.repeat(np.arange(len(every)), [len(ps) for ps in every])
        z = np.full(len(texts), -np.inf)
        if found:
            np.maximum.at(z, owner, self._sums(found))
        return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30))))


def fit(docs: DataFrame, labelled: DataFrame | None, text: str = "text", sample_text: str = "texto", label: str = "etiqueta", none: str = "ninguna") -> Model:
    """Train on the distinct passages of all documents and on the labelled rows.

    The driver gets the patterns of votes with their counts and one weight a bucket.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [_plain_passages(t) for t in b.column(0).to_pylist()]
            some = [[p for p in ps if disguises(p)] if more else [] for ps, more in zip(own, undisguise(own))]
            found = {_DIGITS.sub("7", undisguised(p) if p in odd else p) for ps, odd in zip(own, map(set, some)) for p in ps}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["p"])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_packed(votes(b.column(0).to_pylist())), pa.int64())], names=["p", "fired"])

    found = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(split, "p string").distinct()
    found = keep(found.mapInArrow(vote, "p string, fired long"), "votes")
    counts = {r[0]: r[1] for r in found.groupBy("fired").count().collect()}
    rows = [] if labelled is None else labelled.select(F.col(f"`{sample_text}`"), F.col(f"`{label}`")).where(f"`{sample_text}` IS NOT NULL AND `{label}` IS NOT NULL").orderBy(sample_text, label).limit(LABELLED).collect()
    known = _known([(r[0], r[1] != none) for r in rows])
    if not counts:
        return fit_passages([], [(r[0], r[1] != none) for r in rows])
    target, known_target = _targets(counts, known)
    shards = -(-sum(counts.values()) // SHARD)

    def shard(t: pa.Table) -> pa.Table:
        both = sorted(zip(t["p"].to_pylist(), t["fired"].to_pylist()))
        names, w, bias, often = _classifier([p for p, _ in both], np.array([target[f] for _, f in both]), known, known_target)
        return pa.table({"t": pa.array([*names, -1], pa.int32()), "n": pa.array([*often, len(both)], pa.int64()), "w": pa.array([*w, bias], pa.float64())})

    # a bucket's weight is the mean over the shards that have it, by its occurrences there; the bias goes as bucket -1
    each = found.withColumn("s", F.pmod(F.xxhash64("p"), F.lit(shards))).groupBy("s").applyInArrow(shard, "t int, n long, w double")
    mean = each.groupBy("t").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("w")).toArrow()
    t, w = mean["t"].to_numpy(), mean["w"].to_numpy()
    return Model(t[t >= 0], w[t >= 0], float(w[t < 0][0]))


def _known(rows: Sequence[tuple[str, bool]]) -> list[tuple[str, float]]:
    """(passage, label) of labelled texts; of an abusive one the passage with most votes is labelled, the others are left open (-1)."""
    out = []
    for t, y in rows:
        found = passages(t)
        worst = int(votes(found).sum(1).argmax()) if y and len(found) > 1 else -1
        out += [(p, float(y) if worst in (-1, i) else -1.0) for i, p in enumerate(found)]
    return out


def _targets(counts: dict[int, int], known: Sequence[tuple[str, float]]) -> tuple[dict[int, float], np.ndarray]:
    """The probability of every pattern of votes, and that of the known passages, by the label model over both."""
    patterns = sorted(counts)
    label = np.array([-1.0] * len(patterns) + [y for _, y in known])
    v = np.concatenate([_unpacked(patterns), votes([p for p, _ in known])])
    model = LabelModel().fit(v, label, np.array([counts[x] for x in patterns] + [1] * len(known), float))
    target = np.where(label >= 0, label, model.posterior)
    return dict(zip(patterns, target[: len(patterns)].tolist())), target[len(patterns) :]


def _classifier(unique: Sequence[str], target: np.ndarray, known: Sequence[tuple[str, float]], known_target: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    target = np.concatenate([target, known_target])
    label = np.array([-1.0] * len(unique) + [y for _, y in known])
    # passages on which the voters don't settle teach little
    sure = np.abs(target - 0.5) * 2
    weight = np.where(label >= 0, 1.0, sure**2)
    positive = (weight * target).sum()
    weight = weight * np.where(target > 0.5, max(1.0, (weight.sum() - positive) / max(positive, 1.0) / 2), 1.0)
    return train([*unique, *(p for p, _ in known)], target, weight)


def fit_passages(pool: Sequence[str], rows: Sequence[tuple[str, bool]]) -> Model:
    """Label model over passages and labelled rows, then the classifier, in one place."""
    unique = sorted({_DIGITS.sub("7", p) for p in pool})
    known = _known(rows)
    if not unique and not known:
        return Model()
    fired = _packed(votes(unique)).tolist()
    target, known_target = _targets(Counter(fired), known)
    return Model(*_classifier(unique, np.array([target[f] for f in fired]), known, known_target)[:3])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, puntaje): the score of every document; 0 for null and empty texts.

    Repeated rows come out as often as they stand; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.documents(b.column(1).to_pylist()), pa.float64())], names=["k", "puntaje"])

    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(scan, f"k {kind}, puntaje double").withColumnRenamed("k", key)


def rates(docs: DataFrame, scored: DataFrame, source: str = "source", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(source, documentos, casos, parte): share of cases by source; a null source is one of its own."""
    joined = docs.select(F.col(f"`{key}`"), F.col(f"`{source}`")).join(scored, key)
    return joined.groupBy(source).agg(
        F.count("*").alias("documentos"), F.count_if(F.col("puntaje") >= threshold).alias("casos"), F.round(F.count_if(F.col("puntaje") >= threshold) / F.count("*"), 6).alias("parte"),
    )

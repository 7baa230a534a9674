"""Line grammar of captured news pages.

A page text is a sequence of lines; every stage that tells the article from
the rest of its page works on the same classes:

``FURN``   page furniture recognised by its wording (notices, share prompts ...)
``HEAD``   heading of a list of links to other notes
``LINK``   a one-line teaser to another note
``NAV``    menu or breadcrumb of several entries
``MENU1``  a single menu entry, which may also be a section label
``AD``     advertising marker
``EMBED``  leftover of an embedded part
``RES``    template residue, filler, error or script notice
``LABEL``  section label, byline, date line, sign-off
``TEXT``   anything else

Wording is matched on a *key*: lower case, HTML entities undone and every
character outside ASCII dropped, while the patterns make each accented letter
optional.  A line thus matches whether it is stored correctly, without
accents, in a wrong encoding, or with letters lost to replacement marks.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

FURN, HEAD, LINK, NAV, MENU1, AD, EMBED, RES, LABEL, TEXT, BLANK = (
    "FURN", "HEAD", "LINK", "NAV", "MENU1", "AD", "EMBED", "RES", "LABEL", "TEXT", "BLANK",
)

_ACCENT = str.maketrans({c: f"{b}?" for c, b in zip("áéíóúüñ", "aeiouun")})
_MARKS = re.compile(r"(?<=\d)\?(?= ?c\b)| \?(?= )|(?<=[a-z])\?(?=[a-z])|^\?(?=[a-z])|(?<=[a-z]) ?\?(?= [a-z]|$)")
_SPACE = re.compile(r"\s+")


def key(line: str) -> str:
    """Encoding-proof form of a line: ASCII, lower case, single spaces."""
    if "&" in line and ";" in line:
        line = html.unescape(line)
    k = line.lower().encode("ascii", "ignore").decode()
    if "?" in k:
        k = _MARKS.sub("", k)
    return " ".join(k.split())


def _compile(*parts: str) -> re.Pattern[str]:
    return re.compile("|".join(f"(?:{p.translate(_ACCENT)})" for p in parts))


def _first_words(p: str) -> set[str]:
    """Words a pattern may begin with; the empty word where it begins otherwise."""
    if not p.startswith("(?:"):
        m = re.match(r"([a-záéíóúüñ]+)(?![?*{\[(])", p)
        return {m[1] if m else ""}
    depth, start, parts = 0, 3, []
    for i, c in enumerate(p):
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                parts.append(p[start:i])
                break
        elif c == "|" and depth == 1:
            parts.append(p[start:i])
            start = i + 1
    return set().union(*map(_first_words, parts))


class _Words:
    """Alternatives grouped by their first word, so that a line meets few of them."""

    def __init__(self, *parts: str):
        groups: dict[str, list[str]] = {}
        for p in parts:
            for w in _first_words(p):
                for form in {fold_word(w), w.encode("ascii", "ignore").decode()}:
                    groups.setdefault(form, []).append(p)
        self._by = {w: _compile(*ps) for w, ps in groups.items()}

    def match(self, k: str, word: str) -> bool:
        r = self._by.get(word)
        return r is not None and r.match(k) is not None


_FOLD = str.maketrans("áéíóúüñ", "aeiouun")


def fold_word(w: str) -> str:
    return w.translate(_FOLD)


_FIRST = re.compile(r"[a-z]*")


# Menu entries of news sites.
MENU = (
    "inicio portada nacional nacionales internacional mundo estado estados municipios seguridad deportes cultura "
    "economía política salud tecnología clima opinión videos galerías fotogalerías podcast podcasts hemeroteca "
    "clasificados contacto directorio espectáculos negocios finanzas ciencia sociedad local locales región columnas "
    "editorial multimedia suscríbete suscripciones buscar menú home noticias entretenimiento estilo turismo autos"
).split()
_MENU = _compile("(?:" + "|".join(sorted(MENU, key=len, reverse=True)) + "|edición impresa|en vivo|última hora|lo último)")
_MENU_ITEM = f"(?:{_MENU.pattern})"
_NAV_ROW = re.compile(rf"{_MENU_ITEM} ?(?:[|>/*-] ?| ){_MENU_ITEM}(?= |$)(?: ?(?:[|>/*-] ?| )?{_MENU_ITEM}(?= |$))*")
_NAV_ONE = re.compile(rf"{_MENU_ITEM}")

# Wording of page furniture, matched from the start of the key.
_FURN = _Words(
    # consent and privacy
    r"(?:utilizamos|usamos|este sitio (?:web )?(?:usa|utiliza)|we use) cookies", r"we (?:and our|value your)",
    r"valoramos su privacidad", r"su privacidad es importante", r"este sitio guarda pequeños archivos",
    r"al pulsar .{0,20}usted acepta", r"rechazar lo no esencial", r"gestionar consentimiento", r"aceptar todas",
    r"(?:configurar|administrar) (?:preferencias|cookies)", r"aviso de privacidad\b", r"política de (?:privacidad|cookies)\b.{0,60}$",
    # legal and imprint
    r"queda prohibida la reproducción", r"prohibido copiar", r"derechos de autor y marcas", r"todos los derechos reservados",
    r"la información publicada puede cambiar",
    r"los comentarios y opiniones publicados", r"certificado de licitud", r"quejas y aclaraciones",
    r"oficinas: .*conmutador", r"publicidad y ventas\b.*\|", r"volver (?:arriba|al inicio)$", r"mapa del sitio",
    r"reserva de derechos",
    # share, follow, comment
    r"comparte (?:esta nota|en tus redes|esto)", r"compartir ?:", r"compartido [\d,.]+ veces", r"copiar enlace$",
    r"guardar ?\|", r"envía esta historia", r"síguenos\b", r"[\d,.]+ comentarios?$", r"[\d,.]+ personas están leyendo",
    r"danos tu opinión", r"deja (?:tu|un) comentario", r"imprimir ?\|", r"comentar ?\|",
    # subscription and membership
    r"suscríbete\b", r"regístrate gratis", r"ya eres suscriptor", r"te quedan [\d,.]+ artículos",
    r"apoya el periodismo", r"el resumen de la tarde", r"recibe las noticias", r"únete a nuestra comunidad",
    r"hazte (?:socio|suscriptor)", r"inicia sesión para", r"descarga (?:nuestra|la) app",
    # tickers and counters of the page
    r"tiempo de lectura", r"última actualización", r"edición [\d,.]+ ?año [\d,.]+$", r"dólar: ?\$? ?[\d.,]+",
    # tags and author boxes
    r"(?:temas|etiquetas|tags|palabras clave) ?:", r"equipo de .{1,90} que da seguimiento", r"sobre quien escribe",
    r"(?:reportera|reportero) de .{1,90}escríbele", r"(?:periodista|corresponsal|redactora|redactor) (?:de|en) .{1,90}(?:escríbele|síguel)",
)

# Headings above lists of other notes; names of the outlet may follow.
_HEAD = _Words(
    r"más (?:de esta sección|de la sección|noticias|leídas?|leídos?)$", r"(?:de la misma autora|del mismo autor):?$", r"hace un año en .{2,70}[^.]$",
    r"lo más (?:leído|visto|reciente|compartido):?$", r"sigue leyendo:?$", r"lecturas recomendadas:?$", r"no te pierdas:?$", r"te puede interesar:?$",
    r"te recomendamos:?$", r"contenido de nuestros socios:?$", r"otras noticias:?$", r"en portada:?$", r"también en .{2,70}[^.]$", r"(?:nota|notas) relacionadas?:?$",
    r"noticias relacionadas:?$", r"artículos relacionados:?$", r"lo último:?$", r"(?:recomendados|recomendadas)(?: para ti)?:?$", r"podría interesarte:?$", r"tendencias:?$",
)

_LINK = _Words(
    r"(?:lee|lea|ver|ve|mira|te puede interesar|no te pierdas|relacionado|relacionada|en contexto|más información|consulta|conoce)(?: también| además| más| aquí)? ?[:|>]",
    r"(?:lee|lea|ver) (?:también|además)\b", r">> ?\w", r"> ?\w", r"te recomendamos ?:",
)
_AD = _Words(
    r"publicidad ?-?$", r"- ?publicidad ?-?$", r"anuncio$", r"contenido patrocinado$", r"continúa leyendo después del anuncio", r"espacio publicitario",
    r"patrocinado(?: por .{1,40})?$", r"advertisement$",
)
_EMBED = _Words(
    r"(?:undefined|null|nan|\[object object\])$", r"no se pudo cargar (?:el|la) (?:reproductor|contenido|video|widget|imagen|galería)",
    r"habilita javascript para ver est[ea] (?:video|galería|contenido incrustado|mapa|gráfic[oa])", r"el reproductor requiere",
    r"infografía no disponible", r"error al cargar el contenido incrustado", r"cargando comentarios", r"para ver los comentarios",
    r"\{\{ ?ad[_\w]* ?\}\}$", r"%%\w+%%$", r"\[(?:galeria|gallery|video|embed|caption|audio|mapa|tweet)\b[^\]]*\]$", r"<!--.*-->$", r"\[/?\w+\]$",
    r"\{\{[\w. ]*(?:ad|banner|widget|embed|slot)[\w. ]*\}\}$", r"ver esta publicación en",
)
_LABEL = _Words(
    r"por:? (?!que |qu |la |las |el |los |otra |ultimo|ltimo|favor)\S+(?: \S+){0,4}$", r"texto: .{2,50}$", r"(?:foto|fotos): ", r"de la redacción$", r"redacción\b.{0,70}$", r"\d{1,2} de \w+ (?:de|del) \d{4}\b.{0,30}$",
    r"mesa de redacción", r"-+ ?mesa de redacción", r"\(con información de", r"\(?fuente:",
)


_THING = "(?:page|url|article|story|content|site|resource|página|nota|artículo|contenido|sitio|recurso)"
_GONE = (
    r"(?: you \w+(?: \w+)*| que \w+(?: \w+)*| solicitad[oa])? (?:(?:\w+ ){0,2}?(?:not|no|cannot)\b(?: \w+){0,2}? (?:found|available|exists?|encontrad[oa]|disponible|existe)|"
    r"(?:is |was |has been |fue |ha sido |está )?(?:unavailable|removed|deleted|eliminad[oa]|retirad[oa]))\b(?: ?[|\-–].*|\W*)$"
)
# Wording that stands where an article should be.
_RES = _Words(
    # filler
    r"(?:lorem|aquí va|escriba aquí|inserte aquí|insertar) ", r"contenido de relleno", r"texto de (?:prueba|ejemplo|relleno)",
    r"este es un (?:párrafo|texto) de (?:ejemplo|prueba)", r"título de la (?:nota|noticia)$", r"bienvenido al gestor", r"\(falta texto\)",
    r"asdf", r"(?:null|undefined|nan)(?: (?:de )?(?:null|undefined|nan))+", r"sin título$", r"hola,? mundo",
    r"(?:pendiente de redactar|texto pendiente|por definir|cargando)(?:\W*$| .{0,30}$)",
    # error pages
    r"(?:4\d\d|5\d\d)(?: .{1,40})?$", r"(?:error|http) ?\d{3}\b", r"página no (?:encontrada|disponible|existe)", r"lo sentimos, (?:el contenido|la página|no)",
    r"el archivo no existe", r"el servidor (?:tardó|no responde|no está)", r"la dirección solicitada", r"dominio en venta", r"sitio en mantenimiento",
    r"(?:service|temporarily|server) (?:temporarily |is )?(?:unavailable|error)", r"ups! ", r"ups!? algo", r"algo salió mal", r"error al establecer una conexión",
    rf"{_THING}{_GONE}", rf"(?:the|la|el|this|esta|este) (?:requested )?{_THING}{_GONE}",
    r"curl error", r"fatal error", r"internal server error", r"bad gateway", r"not found$", r"forbidden$", r"warning: ", r"\{ ?\"(?:status|error|message|code)\"",
    r"(?:bad request|gateway time-?out|request timed out|connection (?:refused|reset|timed out))", r"nota (?:eliminada|no disponible|retirada)",
    # access walls
    r"acceso (?:denegado|restringido)", r"access denied", r"you don't have permission", r"esta nota no está disponible", r"su suscripción no permite",
    r"la sesión ha (?:caducado|expirado)", r"demasiadas solicitudes", r"(?:verifique|verifica|confirme|confirma) que (?:es|eres|no es|no eres) ",
    r"hemos detectado tráfico", r"comprobando (?:la conexión|su navegador|si)", r"checking your browser", r"este contenido (?:no está disponible|es exclusivo)",
    # script notices
    r"(?:please )?(?:turn|enable|activate) (?:on )?(?:javascript|scripts)", r"please (?:turn|enable)", r"javascript (?:is|está|debe)", r"enable scripts",
    r"(?:necesita|necesitas) habilitar", r"por favor,? (?:activa|active|habilita|habilite)", r"este sitio no funciona", r"su navegador (?:tiene|no)",
    r"tu navegador (?:tiene|no)", r"si ve este mensaje", r"espere mientras se (?:inicia|carga)", r"para continuar,? (?:active|habilite)",
    r"you need to enable", r"this (?:site|app|application|page) requires", r"(?:requiere|necesita|requires|needs|se requiere|se necesita)(?: \w+){0,3} javascript", r"javascript (?:es |was |has been |está )?(?:required|needed|disabled|necesario|requerido|obligatorio|desactivado|deshabilitado|not enabled|no está)",
)

# Unfilled places, one grammar for each kind of delimiter; on the stored line.
_PLACE = re.compile(
    r"\{\{[^{}]{0,80}\}\}|\{%[^%]{0,80}%\}|<%[^%]{0,80}%>|[$#]\{[\w.: ]{1,60}\}|\{[A-Za-z_][\w.]{0,50}\}|\{\d{1,2}\}|\[\[[^\[\]]{1,60}\]\]|"
    r"\[[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ_ \d]{0,50}\]|%[A-Z][A-Z_\d]{1,40}%|@@[\w ]{1,40}@@|__[A-Z][A-Z_\d]{2,40}__|<<[\w .]{1,40}>>|<[A-Z][A-Z_]{2,40}>|\$[a-z_]{2,40}\$|"
    r"%\([A-Za-z_]\w{0,40}\)[sdifr]|(?<![\w.])@(?:Model|ViewBag|Html|Url)\.[\w.()]{1,60}|\{\$[\w.>-]{1,60}\}|<\?(?:php|=)[^?]{0,80}\?>|\[%[^%]{0,80}%\]|\*\|[A-Z_:\d]{2,40}\|\*|(?<!\w)#[A-Z][A-Z_\d]{2,40}#|%%[A-Z_]{2,40}%%"
)
#: A single place makes a line residue when it is at least this share of it.
PLACE_SHARE = 0.15
_PLACE_HINT = re.compile(r"[{}<%@\[$_*#]")
# Code and tutorials quote such places; lines that show them as code don't count.
_CODE = re.compile(r"`|</?(?:code|pre)\b|\b(?:def|function|import|return|print|var|const)\b.*[(;=]|^\s{4,}\S")
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla "
    "pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_ASCII_WORD = re.compile(r"[a-z]+")


_CROSSES = re.compile(r"x{3,}(?: x{3,})*\W*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
# Words of messages about the page itself.
_PAGE_WORDS = frozenset("javascript navegador browser cookies error servidor server página pagina page scripts script recargue recarga reload robot captcha acceso permiso permission enable habilite habilitar active activar disabled unavailable disponible dirección url".split())


def _of_messages(k: str) -> bool:
    """Whether messages make at least half of a line that begins with one."""
    parts = _SENTENCE.split(k)
    said = sum(len(x) for x in parts if _RES.match(x, _FIRST.match(x)[0]) or sum(w in _PAGE_WORDS for w in _ASCII_WORD.findall(x)) > 1)
    return 2 * said >= len(k)


def residue(line: str, k: str) -> bool:
    """Whether a line is template residue, filler, an error message or a script notice."""
    word = _FIRST.match(k)[0]
    # a message fills a short line; a long one may be an article that begins with it
    if _RES.match(k, word) and (len(line) < 200 or _of_messages(k)):
        return True
    if k[:3] == "xxx" and _CROSSES.fullmatch(k):
        return True
    if _PLACE_HINT.search(line) and not _CODE.search(line):
        places = _PLACE.findall(line)
        if len(places) > 1 or places and len(places[0]) >= PLACE_SHARE * len(line.strip()):
            return True
    if word in _LATIN or " ipsum" in k or " dolor" in k or " consequat" in k:
        w = _ASCII_WORD.findall(k)
        if len(w) > 3 and sum(x in _LATIN for x in w) > 0.7 * len(w):
            return True
    return False


def _classify(line: str) -> str:
    k = key(line)
    if not k:
        return TEXT if line.strip() else BLANK
    word = _FIRST.match(k)[0]
    if _EMBED.match(k, word):
        return EMBED
    if _AD.match(k, word):
        return AD
    if _LINK.match(k, word):
        return LINK
    if len(k) < 90 and _HEAD.match(k, word):
        return HEAD
    if _FURN.match(k, word) or _imprint(k):
        return FURN
    if _NAV_ONE.fullmatch(k):
        return MENU1
    if _NAV_ROW.match(k) and (_NAV_ROW.fullmatch(k) or len(k) < 100):
        return NAV
    if len(k) < 90 and _LABEL.match(k, word) and not k.endswith("."):
        return LABEL
    return RES if residue(line, k) else TEXT


def _imprint(k: str) -> bool:
    """Notices whose first words are a name."""
    if "publicaci" in k and " editada por " in k:
        return True
    if "| hecho en " in k:
        return True
    if "todos los derechos reserv" in k and len(k) < 160:
        return True
    return "nublado" in k and _SKY.match(k) is not None


_SKY = re.compile(r".{2,45}, ?-?\d+ ?(?:&\w+;)?c, (?:parcialmente |mayormente )?nublado")


_known = lru_cache(maxsize=1 << 14)(_classify)


def classify(line: str) -> str:
    """Class of one line by its wording alone."""
    # long lines seldom repeat and aren't remembered
    return _known(line) if len(line) <= 420 else _classify(line)


_FENCE = re.compile(r"\s*(?:```|~~~)")
_OPENS, _CLOSES = re.compile(r"<(?:pre|code)\b", re.I), re.compile(r"</(?:pre|code)>", re.I)


def classify_page(parts: list[str]) -> list[str]:
    """Classes of the lines of a page; inside a block of code nothing is residue."""
    out = list(map(classify, parts))
    if RES not in out and EMBED not in out:
        return out
    code = set()
    fences = [i for i, x in enumerate(parts) if _FENCE.match(x)]
    for a, b in zip(fences[::2], fences[1::2]):
        code.update(range(a, b + 1))
    start = None
    for i, x in enumerate(parts):
        if start is None and _OPENS.search(x):
            start = i
        if start is not None and _CLOSES.search(x):
            code.update(range(start, i + 1))
            start = None
    return [TEXT if i in code and c in (RES, EMBED) else c for i, c in enumerate(out)] if code else out

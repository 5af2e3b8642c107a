"""Documents with template residue or messages of software, by mined message templates and unresolved slots."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrion.llm.cues import cues, fold
from quarrion.session import durable

#: Tokens that the prefix tree tells apart after the number of tokens; later ones become wildcards where they vary.
DEPTH = 3
#: Different tokens at a place beyond which the place is a wildcard.
VARIETY = 12
#: Hashes of messages (8 bytes each) up to which they are broadcast; more are joined by a shuffle.
MOST_SENT = 500_000
#: The wildcard of a place; it counts as a word of no kind.
ANY = "<any>"
#: Cues that a worker remembers before it starts anew.
REMEMBERED = 300_000

_NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)*"
#: How template languages mark a place to be filled.
SLOT = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\{{%-?\s*{_NAME}[^%]*%\}}|<%=?\s*{_NAME}\s*%>|[$#]\{{\s*{_NAME}\s*\}}|\{{{_NAME}\}}|\[\[\s*{_NAME}\s*\]\]|<<\s*{_NAME}\s*>>"
    rf"|&lt;\s*{_NAME}\s*&gt;|@@{_NAME}@@|\$[A-Za-z][A-Za-z_.]*\$|%[A-Za-z][A-Za-z_.]*%|__[A-Za-z][A-Za-z_.]*?__|%\({_NAME}\)s|[\[<]\s*(?:INSERT|YOUR)\s[^\]>]*(?:HERE|TEXT|NAME)\s*[\]>]|\[\s*(?:TODO|FIXME|TBD)\b[^\]]*\]"
)

#: Vocabulary of software's messages in the corpus's languages, compared after folding; a star stands for any ending.
#: Things that only software speaks of, things that it speaks of beside others, what goes wrong with them, what a user is asked to do, what
#: is under way, what a text stands in for, the texts it stands in for, and words that carry no meaning of their own.
WORDS = {
    "own": """javascript noscript html http https url urls api json xml css cookie cookies browser browsers navegador navegadores navigateur navigateurs webbrowser database datenbank gateway proxy captcha exception traceback
        typeerror timeout runtime plugin plugins token quota undefined null nan server servers servidor servidores serveur serveurs website websites webseite webseiten login subtitle subtitles untertitel* subtitulo* subtítulo* sous-titre* legenda legendas
        tonspur werbeblocker adblock* firewall ssl hostname php sql render* script scripts skript skripte stylesheet download* upload* rate_limited ad+blocker ad+block adblocker webserver datenbank* zeitüberschreitung* serverfehler api-key api-schlüssel syntax stack endpoint bandwidth buffer firmware update updates codec codecs player mediaplayer subtítulos sottotitoli""",
    "thing": """page pages seite seiten página páginas file files datei dateien fichier fichiers archivo archivos arquivo arquivos content contents inhalt inhalte contenu contenido* conteúdo* video videos vidéo vidéos vídeo vídeos caption captions track stream account konto compte cuenta conta
        access zugriff zugang accès acceso acesso password passwort contraseña senha limit limite límite robot robots bot status code error errors fehler erreur erreurs erro erros request requests anfrage requête solicitud solicitação session sessions sitzung sesión sessão connection verbindung connexion conexión conexão
        service dienst servicio serviço region regions région región região country pays país resource ressource recurso query thread clients host document dokument documento credentials preview preloader operation process profile app application anwendung aplicación aplicativo network netzwerk netzwerk* réseau internet système sistema sistemas système system systems datos dados daten données base zugangsdaten speicher* memory mémoire memoria memória link links lien liens enlace enlaces formular form site sites subscription abonnement suscripción assinatura passe module pointer segment segmentation fault core dump dumped maintenance mantenimiento manutenção wartung* solicitudes solicitações requêtes anfragen user users benutzer* utilisateur* usuario* usuário* client kunde* format formats formato formatos module modules argument argumento parameter parámetro* parâmetro* literal input output eingabe ausgabe entrée entrada saída id requested load loaded geladen charger chargé* cargar cargado* carregar carregado* angefordert* demandé* solicitad* permission permissions berechtigung* permiso permissão""",
    "wrong": """unavailable denied forbidden failed failing failure expired blocked blocks disabled required invalid exceeded missing unexpected unknown uncaught fatal internal interrupted rejected refused bad occurred permanently permission unauthorized unauthorised unhandled unsupported unreachable unresponsive overloaded corrupt corrupted malformed violation aborted terminated crashed offline suspended banned revoked not+responding needed authentication+required broke broken isn't overloaded plus+disponible n'est+plus null+pointer removed deleted supprimé* eliminad* removid* entfernt proper redirected outdated deprecated exhausted mismatch undefined
        abgelaufen verweigert gesperrt fehlgeschlagen ungültig* deaktiviert erforderlich überschritten aufgetreten unterbrochen kein+zugriff keine+verbindung keine+berechtigung überlastet verloren beschädigt gelöscht ungenügend unzulässig nicht+unterstützt unterstützt+dieses unterstützt+nicht unbekannt* veraltet interne* interner unerwartet* introuvable* indisponible* refusé* interdit* échoué échec expiré* bloqué* bloque désactivé* requis* invalide* dépassé* survenu* inattendu* non+trouvé* ne+répond temporairement surchargé* perdu* interne non+pris non+autorisé* erroné* corrompu* trop+de a+expiré en+maintenance inaccessible* inconnu*
        denegad* prohibid* falló fallid* expirad* caducad* bloquead* deshabilitad* desactivad* requerid* requiere inválid* excedid* producido inesperad* no+responde demasiad* sobrecargad* perdid* interno dañad* no+válid* en+mantenimiento no+compatible no+autorizad* desconocid* no+hay indisponível negad* proibid* interno não+responde muit* sobrecarregad* perdid* corrompid* não+suportad* em+manutenção no+momento não+autorizad* desconhecid* não+há falhou falha expirou desativad* necessári* ocorreu
        not+found not+available no+longer not+exist not+supported could+not+find could+not couldn't cannot moved verschoben déplacé* movid* unable+to too+many went+wrong timed+out not+be+found not+load turned+off switched+off reached+your
        nicht+gefunden nicht+verfügbar konnte+nicht konnten+nicht kann+nicht existiert+nicht nicht+mehr nicht+erreichbar muss+aktiviert n'est+pas n'existe impossible+de pas+pu no+encontrad* no+disponible no+se+pudo no+existe no+se+encontr* no+está não+encontrad* não+foi não+existe não+aceita não+está não+disponível must+be+enabled is+down no+captions no+subtitles no+results no+data no+connection no+access not+allowed not+authorized not+respond not+responding not+valid access+violation""",
    "ask": """please bitte veuillez enable activate allow reload refresh retry verify click accept disable upgrade reconnect restart contact install needs+scripts turn+on switch+on try+again log+in sign+in check+back aktivieren einschalten laden neu aktualisieren versuchen anmelden+um melden+sie anmelden melden fortzufahren fortfahren warten bestätigen wiederholen prüfen überprüfen installieren activer activez autoriser autorisez recharger rechargez actualiser actualisez réessayer réessayez connecter vérifier vérifiez patienter patientez reconnectez désactivez désactiver installez contactez cliquez connectez
        por+favor habilite habilitar active activar permita recargue recargar actualice inténtelo intente vuelva inicie verifique espere desactive instale contacte conéctese cargue pulse reintente ative ativar recarregue recarregar atualize tente aguarde desative instale contate clique conecte carregue conectar to+continue para+continuar pour+continuer""",
    "runs": """loading redirecting checking verifying connecting fetching rendering processing buffering wird+geladen werden+geladen chargement cargando carregando while+we""",
    "stand": """placeholder platzhalter* dummy sample example+text beispieltext beispiel ejemplo exemplo replace insert enter type add your here pending provisional pendiente pendente ausstehend provisoire* provisori* provisóri* folgt à+venir eingeben einfügen hier goes tbd todo escriba inserte ingrese aquí saisissez insérez ici insira digite escreva aqui replace+me""",
    "text": """text platzhaltertext texte texto textos caption captions subtitle subtitles untertitel* sous-titre* subtítulo* legenda legendas line lines translation übersetzung traduction traducción tradução title titel titre título name cue dialogue""",
    "plain": """the this that a an of in on for to your you we is are was were has have been be at by and or it from with as one two three before after later available verfügbar view display anzeigen now in der die das diese dieser dieses den dem ihr ihre ihren sie ist sind wurde werden sein am im um zu und oder mehr derzeit mit votre vos le la les cette ce ces est une un du de des dans et ou au aux pas n'a disponible su sus el los las esta este ha en y o que se al del una por sua seu seus o a os as na no um uma em e ou do da está foi ao disponível""",
}
#: The usual words of filler text in mock Latin.
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
#: Cues that are nothing but what software prints for a missing value, or keys struck at random.
BARE = re.compile(r"(?:undefined|null|nan|none|nil|n/a|tbd|todo|lorem ipsum|\[object object\]|(?:x{3,}[ .]*)+|(?:asdf|qwerty|qwertz|test|foo|bar)(?: (?:asdf|qwerty|qwertz|test|foo|bar))+)[.!]?", re.I)
#: Signs of speech, and marks of a web page or a program's output.
SPEECH = re.compile(r"\b(?:i|i'm|i’m|me|my|mine|he|she|his|him|her|they|us|our|ich|mir|mein\w*|er|je|j'ai|moi|mon|ma|il|elle|ils|yo|mi|ella|eu|meu|minha|ele|ela)\b|[?!](?:\s|$)|[¿¡](?=\s?[^\W\d_])(?<!\w.)|♪", re.I)
PAGE = re.compile(r"<!doctype html|</?html\b|<noscript|<body\b", re.I)
PROGRAM = re.compile(r'\{"\w+":|\b\w+(?:Error|Exception)\b|\b\w+\.(?:py|js|java|php|rb|go|cpp)\b|\b[a-z]+_[a-z_]+\b|\b[A-Z]{2,} \w+ FROM\b|\b[a-z]+\.[A-Z]\w+:|^\s*(?:fatal )?error:|\bHTTP\b')
_CODE = re.compile(r"\b(?:error|fehler|erreur|erro|code)\s+<\*>", re.I)
_CLASS = re.compile(r"\b[A-Z]\w*(?:Error|Exception)\b")
_CALLED = re.compile(r",\s+([^\s,.?!…]+)\s*[.?!…]")
_SITE = re.compile(r"\b(?:www\.|[\w-]+\.(?:com|net|org|io|example|test|info)\b)", re.I)
_DIGITS = re.compile(r"\d+")
_SENTENCE = re.compile(r"(?<=[.!?…:;])\s+")


def _lexicon() -> tuple[dict[str, set[str]], list[tuple[str, str]], list[tuple[str, str]]]:
    """Folded words with their kinds, and folded phrases and beginnings with theirs."""
    words, phrases, starts = {}, [], []
    for kind, listed in WORDS.items():
        for w in listed.split():
            f = fold(w.replace("+", " ").replace("-", " ").replace("'", "").rstrip("*"))
            if "+" in w or " " in f:
                phrases.append((f, kind))
            elif w.endswith("*"):
                starts.append((f, kind))
            else:
                words.setdefault(f, set()).add(kind)
    return words, phrases, starts


_WORD, _PHRASE, _START = _lexicon()
_FIRST = {p.split(" ")[0] for p, _ in _PHRASE}
_LOREM = frozenset(map(fold, LOREM))
_TELLING = {w for w, kinds in _WORD.items() if kinds & {"own", "thing", "stand", "text"} and not kinds & {"plain"}} | {f for f in _LOREM if len(f) > 3} | {p.split(" ")[0] for p, k in _PHRASE if k in ("own", "thing", "stand", "text")} | {w for w, kinds in _WORD.items() if kinds == {"wrong"}}
_BEGIN = {}
for _s, _k in _START:
    _BEGIN.setdefault(_s[:3], []).append((_s, _k))


def masked(cue: str) -> str:
    """A cue with <*> for every run of digits."""
    return _DIGITS.sub("<*>", cue)


def _folded(text: str) -> list[str]:
    return fold(text.replace("<*>", " ").replace("-", " ").replace("'", "").replace("’", "")).split()


def _telling(text: str) -> bool:
    """Whether any word of a text is one that a message must have."""
    return any(w in _TELLING or w[:3] in _BEGIN and any(w.startswith(s) for s, _ in _BEGIN[w[:3]]) for w in _folded(text)) or bool(PROGRAM.search(text) or _CLASS.search(text))


def features(text: str) -> dict[str, int]:
    """How many words of a text are of each kind of the vocabulary; ``words`` in all, ``other`` of none.

    Words are folded, so recognition and encoding errors do not count. A phrase gives its kind to all its words.
    """
    words = _folded(text)
    kinds = [set(_WORD.get(w, ())) for w in words]
    for k, w in enumerate(words):
        for s, kind in _BEGIN.get(w[:3], ()):
            if w.startswith(s):
                kinds[k].add(kind)
        if w in _FIRST:
            rest = " ".join(words[k : k + 4])
            for p, kind in _PHRASE:
                if rest.startswith(p) and (len(rest) == len(p) or rest[len(p)] == " " or kind == "wrong" and p[-1] != " " and len(p) > 8):
                    for x in kinds[k : k + p.count(" ") + 1]:
                        x.add(kind)
    out = {k: sum(k in x for x in kinds) for k in WORDS}
    out["words"], out["other"] = len(words), sum(not x for x in kinds)
    out["lorem"] = sum(w in _LOREM for w in words)
    out["said"] = sum(bool(x - {"plain"}) for x in kinds)
    return out


def _stands(f: dict[str, int]) -> bool:
    """Whether a stretch is filler or says that a text is still to come."""
    n = f["words"]
    if f["lorem"] >= 3 and f["lorem"] >= 0.8 * n or f["lorem"] == n >= 2 and f["plain"] < n:
        return True
    if f["stand"] and f["text"] and not f["other"] and n <= 8 and f["stand"] + f["text"] + f["plain"] >= n and f["said"] >= 2:
        return True
    if f["stand"] >= 2 and n <= 4 and f["stand"] == n and not f["plain"]:
        return True
    return False


def _says(text: str, f: dict[str, int]) -> bool:
    """Whether a stretch of one or two sentences is what software says, by its features alone."""
    n = f["words"]
    program = bool(PROGRAM.search(text))
    acts = bool(f["wrong"]) + bool(f["ask"]) + bool(f["runs"])
    # a code beside what went wrong, and a program's own names, are as good as a thing
    things = 2 * min(2, f["own"]) + min(3, f["thing"]) + (bool(f["wrong"]) and "<*>" in text) + bool(_CLASS.search(text))
    if (things and acts or f["own"] >= 2 and n <= 6) and not f["other"]:
        return True  # nothing but such words
    if things and acts and f["other"] == 1 and n <= 9 and not _SITE.search(text):
        return True  # a single other word: what is asked of or wrong with the thing
    if things and (program and f["other"] < n / 2 or not f["other"] and _CODE.search(text)):
        return True
    if _SITE.search(text) and not (f["wrong"] or f["runs"]):
        return False  # an advert asks for a visit
    return bool(acts) and things + 1.5 * acts >= 3.5 and f["said"] >= 0.25 * n


def spoken(text: str) -> bool:
    """Whether a stretch has a sign of speech: a pronoun, a question or call, or someone addressed at a sentence's end."""
    called = _CALLED.search(text + ".")
    return bool(SPEECH.search(text.rstrip("!") if text.isupper() else text)) or bool(called and not _WORD.get(fold(called[1])))


def is_message(template: str) -> bool:
    """Whether a template is what software says, filler or a stand-in; wildcards count as words of no kind.

    Every two neighbouring sentences are judged by the kinds of their words, whatever the template's length. Speech that
    mentions such things is told by its signs in and around them.
    """
    plain = template.strip(" -.\"'")
    if BARE.fullmatch(plain) or PAGE.search(plain):
        return True
    if not _telling(template):
        return False
    parts = [p for p in _SENTENCE.split(template) if p.strip()]
    for k in range(len(parts)):
        pair = " ".join(parts[k : k + 2])
        for text in (parts[k], pair) if len(parts) > k + 1 else (parts[k],):
            f = features(text)
            if _stands(f) or _says(text, f) and not spoken(" ".join(parts[max(0, k - 1) : k + 3])):
                return True
    return False


def _parsed(text: str, seen: dict) -> Iterator[tuple[int, str, bool]]:
    """(hash, masked cue, slot) of each cue of a text; what a worker has met is kept."""
    import xxhash

    for cue in cues(text):
        known = seen.get(cue)
        if known is None:
            m = masked(cue)
            known = (xxhash.xxh64_intdigest(m) - (1 << 63), m, SLOT.search(cue) is not None)
            if len(seen) >= REMEMBERED:
                seen.clear()
            if len(cue) < 500:
                seen[cue] = known
        yield known


def _lines(documents: DataFrame) -> DataFrame:
    """(h, cue): the different masked cues of all documents. A task names each of them once, before the only shuffle."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, named = {}, set()
        for batch in batches:
            new: dict[int, str] = {}
            for text in batch.column(0).to_pylist():
                for h, m, _ in _parsed(text, seen) if text and not text.isspace() else ():
                    if h not in named:
                        named.add(h)
                        new[h] = m
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(list(new.values()), pa.string())], names=["h", "cue"])
            if len(named) > 2 * REMEMBERED:
                named.clear()

    return documents.select("text").mapInArrow(read, "h long, cue string").groupBy("h").agg(F.min("cue").alias("cue"))


def _observed(documents: DataFrame) -> DataFrame:
    """(doc_id, h, slot): of each document its different masked cues as hashes, and with h null whether it has an unresolved slot."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            ids, hs, slots = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or text.isspace():
                    continue
                own, slot = set(), False
                for h, _, s in _parsed(text, seen):
                    own.add(h)
                    slot = slot or s
                ids += [doc] * len(own)
                hs += own
                slots += [False] * len(own)
                if slot:
                    ids.append(doc), hs.append(None), slots.append(True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(slots, pa.bool_())], names=["doc_id", "h", "slot"])

    return documents.select("doc_id", "text").mapInArrow(read, "doc_id long, h long, slot boolean")


def _sent(small: DataFrame) -> DataFrame:
    """A kept table of numbers, broadcast if it was counted to hold no more than MOST_SENT rows, else joined by a shuffle."""
    small = durable(small)
    return F.broadcast(small) if small.count() <= MOST_SENT else small


def message_templates(lines: DataFrame) -> DataFrame:
    """(h, cue, template) of different masked cues (h, cue): the templates of a fixed-depth prefix tree.

    The tree's path is the number of tokens and the first DEPTH of them. Below it, a place at which the cues of the
    path show more than VARIETY different tokens is a wildcard; only a path of more cues than that can have one, so
    others are left out before places are counted. Paths and places are counted by aggregation, so that a path taken by very
    many cues never meets in one task.
    """
    tokens = F.split("cue", " ")
    lines = lines.select("h", "cue", F.xxhash64(F.size(tokens), F.array_join(F.slice(tokens, 1, DEPTH), " ")).alias("path"))
    busy = _sent(lines.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > VARIETY).select("path"))
    deep = lines.where(F.size(tokens) > DEPTH).join(busy, "path", "left_semi")
    places = deep.select("path", F.posexplode(F.transform(tokens, lambda x: F.xxhash64(x))).alias("place", "token")).where(F.col("place") >= DEPTH)
    wild = _sent(places.groupBy("path", "place").agg(F.approx_count_distinct("token").alias("n")).where(F.col("n") > VARIETY).groupBy("path").agg(F.collect_set("place").alias("wild")))
    filled = F.array_join(F.transform(tokens, lambda x, i: F.when(F.array_contains("wild", i), F.lit(ANY)).otherwise(x)), " ")
    return lines.join(wild, "path", "left").select("h", "cue", F.when(F.col("wild").isNull(), F.col("cue")).otherwise(filled).alias("template"))


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, reason) of documents with a message template ('message') or an unresolved slot ('slot').

    Texts are read twice: once for their different cues, of which templates are mined and each judged once, and once for
    the documents that hold a cue of a message. A wildcard never hides what a cue says: a cue is a message if it reads as
    one itself, or if its template does and the cue has no sign of speech; a template's wildcards speak against it. The hashes of such cues are counted before
    they are broadcast; no cue's text is shuffled with its documents. Null, empty and blank texts are no residue. A
    document appears once a reason.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            keep = []
            for cue, template in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                verdict = is_message(cue)
                if not verdict and template != cue:
                    if template not in known:
                        known[template] = is_message(template)
                    verdict = known[template] and not spoken(cue)
                if len(known) > REMEMBERED:
                    known.clear()
                keep.append(verdict)
            yield batch.filter(pa.array(keep, pa.bool_())).select([0])

    bad = _sent(message_templates(durable(_lines(documents))).mapInArrow(judge, "h long"))
    found = _observed(documents).join(bad.withColumn("hit", F.lit(True)), "h", "left").where("hit or slot")
    return found.select("doc_id", F.when(F.col("slot"), "slot").otherwise("message").alias("reason")).distinct()

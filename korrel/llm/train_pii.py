"""Trains the BiLSTM-CRF of pii.py: python -m korrel.llm.train_pii TABLE_DIR... [--out FILE]

Labelled spans come from two places. A bounded sample of the texts of the given directories (``TEXTS`` of each table, in
the order of a hash) is labelled by the patterns below: the forms of numbers, streets and addresses, and the phrases in
which persons stand. A surname is any capitalised word in such a phrase, whatever its letters; words that also occur in
small letters, or often, are none behind a weak phrase. In half of the texts the names and streets, and the eponyms that
are no persons, are exchanged for names of the lists below or made-up ones, so that the tagger learns forms and contexts
rather than words. ``MADE`` windows are written from templates over the same lists in four languages.

Windows are the units of whole texts, as pii.py cuts them; all that hold a span are taken and a share (``BARE``) of the
others. After the
first of the rounds of ``STEPS`` steps, and again after the next, the training texts are tagged, and the windows in which
labels and tags differ join the round that follows. Steps and seed are fixed; the clock has no part. The held-out accuracy is printed by kind.
"""

from __future__ import annotations

import glob
import os
import random
import re
import sys
import time
from collections import Counter
from multiprocessing import Pool

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # the matrices are small

import numpy as np

from korrel.llm import pii
from korrel.llm.tagger import FREE, KINDS, LABELS, BiLstmCrf, encode

TEXTS, SAMPLE, MADE, HIDDEN, LENGTH, STEPS, SEED = 24_000, 36_000, 9_000, 24, 160, (9_000, 6_000, 6_000), 7
BARE, OFTEN, WORKERS = 0.12, 40, 7
EMAIL = re.compile(r"[\w.+-]+ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?:(?:\.|\[punt\]|\(punt\)|\[dot\]|\(dot\))[\w-]+)+")
PHONE = re.compile(r"(?<![\w.+-])(?:\+\d\d ?\(?\d?\)?[\d -]{8,12}\d|00\d\d-\d-\d{8}|\d\d-\d{8}|\d\d(?: \d\d){4}|\d\d\.\d\d\.\d{3}\.\d{3}|\(\d{3}\) \d{3}(?:-\d{4}| \d\d \d\d)|\d{3} - \d{7}|0\d{9})(?![\w-]|\.\d)")
IDNUM = re.compile(r"(?<![\w.-])(?:\d{9}|\d{3} \d{3} \d{3}|\d{4}-\d{5}|\d{4}\.\d\d\.\d{3}|\d{7}|\d{3}\.\d{4}|[A-Z]\d{8}|[A-Z]{2}[A-Z\d]{6}\d)(?![\w-]|\.\d)")
NO_IDNUM = re.compile(r"(?i)(?:accessienummer|monsternummer|artikelnummer|lotnummer|sample|échantillon|probennummer|sku|dossier|studie|trial registration|beeld|serie|image|lot|charge|article)\W*(?:no\W*|nr\W*)?\Z")
ADDRESS = re.compile(
    r"(?:(?:[Ll]aan van|[Oo]ude|[Kk]orte|[Ll]ange|[Nn]ieuwe|[Bb]urg\.) )?\b[A-Za-zë]{3,}(?i:straat|laan|kade|dreef|pad|plein|hof|singel|steeg|weg|gracht|straße|strasse|gasse|platz|str\.|pln\.?) (?:nr\. ?)?\d{1,4}(?:[a-zA-Z]\b|-(?:\d{1,3}|I{1,3}|IV)\b| bis\b| hs\b)?(?:, \d{4} ?[A-Z]{2}\b)?(?: (?:te )?[A-Z][a-z]+(?:voort|kerk|veld|dam|burg|schans|ham|hoven|wolde|ningen|ringen|beek|drecht|loo|meer)\b)?"
    r"|\b\d{1,4}(?: bis| ter)?,? (?:rue|avenue|impasse|boulevard|place|chemin|quai|allée) (?:(?:du|de la|de l’|des|de) ?)?[A-Z]\w+"
    r"|\b\d{1,4}\w? [A-Z][a-z]+ (?:Street|St\b\.?|Road|Rd|Lane|Avenue|Ave|Close|Drive)"
    r"|\b(?:Am|Im|Zum|Zur|An der|Auf dem) [A-Z]\w+ \d{1,3}[a-z]?\b"
)

PART = r"(?:(?:van der|van den|van de|van|de|den|der|ter|te|ten|von|el) )?"
INITIALS = r"(?:[A-Z]{1,3}|(?:[A-Z]\.){1,4})"
WORD = r"[A-ZÀ-Ý][a-zà-ÿ]{2,}(?:-[A-ZÀ-Ý][a-zà-ÿ]{2,})*"
STRONG = r"(?:Mevrouw|[Mm]evr\.?|M[Ww]\.?|D[Hh][Rr]\.?|[Dd]e heer|Mrs?\.?|Ms\.|[Dd]r\.?|[Pp]rof\.?|Frau|Herrn?|Mme|M\.|T\.a\.v\.|I\.o\.m\.|collega|Patiënte?:|Patient:|geautoriseerd:|Huisarts:|Naam:|Signed:)"
WEAK = r"(?:[Mm]it|[Aa]vec|[Pp]ar|[Mm]et|[Cc]ontact|spoke to|[Dd]oor|by|[Pp]atiënte?|[Gg]roet,|van de hand van)"
#: Behind a name these make it an eponym, a place or a part of another word.
BEHIND = re.compile(r"\A(?:-[a-z\d]|-(?:[A-Z][a-zü]+|EKG)\b| (?:score|manoeuvre|sign|syndrome|teken|disease|bewaart|bevindt|ase)\b|\w|@|\.\w)")
EPONYM = re.compile(rf"((?:[Zz]iekte|[Ss]yndroom|[Ss]yndrome|classificatie|calciumscore|[Ss]igne|[Tt]ekenen) (?:van|of|de|volgens) )({WORD})|\b((?:De|Het|Een|Das|The|Le) )({WORD})(?=-[a-z]|-(?:Syndrom|Zeichen)| score| sign| manoeuvre)")
#: Names, fixed values for the training only.
FIRST = """Jan Piet Kees Klaas Henk Willem Gerrit Johan Maria Anna Johanna Cornelia Elisabeth Wilhelmina Sanne Lisa Emma Julia Sophie Eva Tess
Lars Sem Levi Finn Milan Luuk Thomas Tim Bas Jeroen Mark Erik Peter Paul Hans Rob Marijn Annelies Ingrid Monique Petra Esther Miriam Yvonne
Karin Astrid Loes Truus Greet Riet Nel Bep Corrie Ali Mohammed Ahmed Yusuf Hassan Fatma Ayse Emine Leyla Samira Nadia Karim Omar Ibrahim
Thomas Michael Andreas Stefan Wolfgang Jürgen Klaus Ursula Monika Sabine Heike Anke Birgit Gisela Pierre Jacques Michel Philippe François
Marie Claire Isabelle Nathalie Sylvie Camille Chloé John James Robert David William Richard Mary Patricia Linda Barbara Susan Karen Nancy
Emily Grace Oliver George Harry Arthur Charlotte Amelia Olga Ivan Piotr Agnieszka Krzysztof Sofia Mateo Lucia Carlos Wei Li Priya Arjun""".split()
LAST = """Jansen Vries Berg Bakker Dijk Visser Smit Meijer Boer Mulder Groot Bos Vos Peters Hendriks Leeuwen Dekker Brouwer Wit Dijkstra Smits
Graaf Meer Linden Kok Jacobs Haan Vermeulen Heuvel Veen Broek Bruijn Bruin Heijden Schouten Beek Willems Vliet Ven Hoekstra Maas Verhoeven
Koster Dam Prins Blom Huisman Peeters Kuipers Veenstra Kramer Postma Kuiper Wal Gerritsen Bosch Wolters Sanders Koning Evers Kuijpers
Hermans Molenaar Timmermans Martens Groen Gerrits Jonker Zijlstra Scholten Haas Yilmaz Kaya Demir Sahin Celik Bouzidi Benali Haddad Amrani
Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz
Martin Bernard Dubois Petit Durand Leroy Moreau Laurent Lefebvre Garcia Roux Fournier Girard Bonnet Lambert Rousseau Smith Johnson Williams
Brown Jones Miller Davis Wilson Anderson Taylor Thomas Moore Jackson White Harris Clark Lewis Walker Hall Young Nowak Kowalski Novak Silva
Santos Pereira Fernandez Rossi Ferrari Nguyen Chen Wang Singh Patel Khan Popescu Ivanov Horvat Nagy Andersson Hansen Nielsen Larsen""".split()
STREETS = """Kerkstraat Dorpsstraat Molenweg Schoolstraat Stationsweg Julianalaan Beatrixlaan Wilhelminastraat Nieuwstraat Hoofdstraat Parallelweg
Industrieweg Kastanjelaan Lindelaan Beukenlaan Eikenlaan Marktplein Herengracht Keizersgracht Prinsengracht Zeedijk Havenkade Singel
Vondelpad Burgemeester_Jansenlaan Van_Goghstraat Rembrandtplein Lange_Voorhout Korte_Poten Laan_van_Meerdervoort Oude_Gracht""".split()
TOWNS = """Utrecht Amsterdam Rotterdam Eindhoven Groningen Tilburg Almere Breda Nijmegen Apeldoorn Haarlem Arnhem Enschede Amersfoort Zaandam Zwolle
Leiden Maastricht Dordrecht Zoetermeer Deventer Delft Alkmaar Leeuwarden Assen Venlo Gouda Hoorn Zeist Ede""".split()
ABROAD = """12_rue_de_la_Paix 8_avenue_Victor_Hugo 45_boulevard_Voltaire 3_place_Bellecour 17_High_Street 221_Baker_Street 5_Station_Road
30_Church_Lane 9_Park_Avenue Hauptstraße_12 Bahnhofstraße_7a Goethestraße_31 Am_Markt_4 Schillerplatz_2""".split()
#: Sentences with persons and with other things; fixed values for the training only.
PERSONS = """{N} belt morgen.|{L} belt vanmiddag terug.|{F} is ingelicht.|{F} belde over de uitslag.|Gebeld door {F}.|Gebeld door {N}, komt morgen.
Bel 112233 voor {F}.|Vraag naar {F} op de afdeling.|contact met de heer {l}|contact gehad met mevrouw {l} over de medicatie|mw {l} is gezien
ik ben {n}|ik heet {n} en ben 34 jaar|Ik ben {N}.|mijn naam is {n}|Mijn zus {F} was erbij.|Zijn broer {F} regelt het vervoer.|zoon {F} is eerste contact
Naam: {N}|Naam: {L}|Naam patiënt {N}|Mevr. {L} heeft klachten.|Mw. {P} komt op controle.|Dhr {I} {P} is opgenomen.|De heer {P} is besproken.
Prof. {L} adviseert een controle.|Mr. {L} was seen today.|Mrs {L} reports pain.|Dr. {L} was informed.|Dear {F},|Beste {F},|Hallo {F}, bedankt!
Gezien door {L}, cardioloog.|Overleg met {L} gehad.|Overlegd met {N} (internist).|Arts: {N}|Verpleegkundige {F} heeft gebeld.|Behandelaar {L}
Met vriendelijke groet, {N}|Groetjes, {F}|Liefs {F} en {F}|{F} en {F} waren aanwezig.|{N} (54 jaar) heeft hartkloppingen.|{N}, geboren in 1954.
Patiënt {N} is gevallen.|Patiënt {L} belde.|{N} was admitted yesterday.|I spoke with {F} this morning.|Her husband {F} agreed.|Call {F} tomorrow.
My name is {N}.|Signed {N}|Frau {P} kommt zur Kontrolle.|Herr {L} wurde entlassen.|Besprochen mit {N}.|Ihr Mann {F} war dabei.|{N} ruft morgen an.
Madame {L} est venue.|M. {L} a été vu.|Vu par le docteur {L}.|Son mari {F} est présent.|{F} {L} a appelé hier.|{L}, {I}|{C}, {I} werd gezien.
Ambulance gebeld door {F}.|De vrouw van {N} belde.|Dochter {F} komt mee.|volgens {F} gaat het goed|Het gesprek met {F} verliep goed.""".replace("\n", "|").split("|")
OTHERS = """De ziekte van {X} is zeldzaam.|Het {X}-teken was positief.|syndroom van {X}|De {X}-score bedraagt 12.|The {X} sign was absent.|{X} disease
classificatie volgens {X}|methode van {X}|het {X}-syndroom|Le syndrome de {X}|Das {X}-Syndrom|Morbus {X}|een {X}-katheter|{X}-index 3
Opgenomen in {T}.|Verwezen naar {T}.|Afkomstig uit {T}.|Ziekenhuis te {T}|In {T} is een nieuw centrum.|Het museum van {T} is open.|Werkgroep {T}.
Bel 112 bij spoed.|Bloeddruk 128/76 mmHg.|Controle op 12-03-2019 om 14.30 uur.|Accessienummer 20190312345, serie 4.|Lotnummer 19-48213.|Artikelnr. 482913
Beeld 112233 van serie 4.|Monsternummer 558213947.|Studie 2013-004512-17.|Maandag belt de afdeling.|Morgen belt de huisarts.|De cardioloog belt terug.
De patiënt is ingelicht.|Familie is ingelicht.|Partner is ingelicht.|Gebeld door de apotheek.|contact met de heer des huizes|ik ben moe
ik ben benauwd en duizelig|Bel 112233 voor spoed.|woont zelfstandig|woont 12 jaar in Nederland|Paracetamol 500 mg, 3 dd 1.|Kamer 12, bed 3.
Vandaag 12 gram.|Deel 3 van 12.|Prijs 45 euro.|Patiënt belt morgen.|Huisarts belt morgen.|Apotheek is gebeld.""".replace("\n", "|").split("|")
PLACES = """woont {S}|Woonachtig {S}|woonachtig aan de {S}|Adres: {S}|adres {S}|Bezorgen op {S}.|Verhuisd naar {S}.|Hij woont in de {S}.|gevallen op {S}
{S}|lives at {S}|wohnt {S}|habite {S}|Thuisadres {S}, graag bellen.|Ik woon aan de {S}.|Huisbezoek {S} op maandag.""".replace("\n", "|").split("|")
NUMBERS = """bel {T}|tel {T}|Tel.: {T}|mobiel {T}|Bereikbaar op {T}.|telefoonnummer {T}|phone {T}|Terugbellen: {T}""".replace("\n", "|").split("|")
IDS = """BSN {B}|bsn: {B}|burgerservicenummer {B}|patiëntnummer {B}|Paspoort {B}|paspoortnummer {B}|ID-kaart {B}|Passport no. {B}|sofinummer {B}""".replace("\n", "|").split("|")
MAILS = """mail naar {M}|E-mail: {M}|e-mailadres {M}|Mailen kan via {M}.|contact {M} please|{M}""".replace("\n", "|").split("|")


def first_names(texts: list[str]) -> list[str]:
    """First names, from phrases that hold one and nothing else."""
    found: dict[str, int] = {}
    for t in texts:
        for m in re.finditer(r"(?:Dochter|Groetjes,|echtgenoot|daughter|Sohn|Sa fille|[Mm]ijn man|[Mm]ijn vrouw) ([A-Z][\w-]+)\b", t):
            found[m[1]] = found.get(m[1], 0) + 1
    return [n for n, c in found.items() if c >= 5]


class Labeller:
    """Spans by patterns; the texts tell which words occur in small letters or often."""

    def __init__(self, texts: list[str]) -> None:
        self.names = set(first_names(texts))
        bare = (re.sub(r"\bMw [a-z]+", " ", EMAIL.sub(" ", t)) for t in texts)
        words = Counter(w for t in bare for w in re.findall(r"[^\W\d_]+", t))
        self.known = {w for w, n in words.items() if w.islower() or n > OFTEN}
        first = "|".join(sorted(map(re.escape, self.names), key=len, reverse=True)) or r"(?!)"
        tail = rf"(?:(?:{INITIALS} )?{PART}{WORD}|[A-ZÀ-Ý]{{4,}}(?:-[A-Z]{{4,}})?)"
        self.strong = re.compile(rf"(?<!\w){STRONG} (?P<n>(?:(?:{first}) )?{tail}(?:, (?:[A-Z]\.){{1,4}})?|(?:{first})\b)")
        self.weak = re.compile(rf"(?<!\w){WEAK} (?P<n>(?:{INITIALS} )?{PART}(?P<w>{WORD}))")
        self.full = re.compile(rf"(?<!\w)(?:{first})(?![\w@])(?P<more>(?: {INITIALS}(?=[ ,]))?(?:,? {PART}(?P<w>{WORD})))?")
        self.low = re.compile(r"(?<!\w)Mw (?P<n>[a-z]{5,})\b")

    def unknown(self, word: str) -> bool:
        """No word of the corpus but, by its looks, a name."""
        return all(w not in self.known and w.lower() not in self.known for w in word.split("-"))

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        taken = np.zeros(len(text), bool)
        out: list[tuple[int, int, str]] = []

        def add(a: int, b: int, kind: str) -> None:
            if b > a and not taken[a:b].any():
                taken[a:b] = True
                out.append((a, b, kind))

        low = text.title() if text.isupper() and len(text.title()) == len(text) else text
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
        for m in ADDRESS.finditer(low):
            add(m.start(), m.end(), "address")
        for m in PHONE.finditer(text):
            add(m.start(), m.end(), "phone")
        for m in IDNUM.finditer(text):
            if not NO_IDNUM.search(text, max(0, m.start() - 24), m.start()) and len(re.findall(r"\d", m.group())) >= 4:
                add(m.start(), m.end(), "idnum")
        for m in self.strong.finditer(text):
            if not BEHIND.match(text[m.end() : m.end() + 14]):
                add(m.start("n"), m.end("n"), "name")
        for m in self.full.finditer(text):
            b = m.end()
            if m["more"] and (not self.unknown(m["w"]) or BEHIND.match(text[b : b + 14])):
                b = m.start("more")
            if not re.match(r"-[A-Za-z]|@|[._]\w", text[b : b + 2]):
                add(m.start(), b, "name")
        for m in self.weak.finditer(text):
            if self.unknown(m["w"]) and not BEHIND.match(text[m.end() : m.end() + 14]):
                add(m.start("n"), m.end("n"), "name")
        for m in self.low.finditer(text):
            if m["n"] not in self.known:
                add(m.start("n"), m.end("n"), "name")
        return sorted(out)


def made_up(rng: random.Random) -> str:
    """A capitalised made-up word."""
    syllables = "ba be bo da de do fa fe ga ha hen ja jo ka ki la le li lo ma me mi mo na ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi wa we wi ya zo an ar el en er in is on or us".split()
    return "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))).capitalize()


def surname(rng: random.Random) -> str:
    return made_up(rng) if rng.random() < 0.3 else rng.choice(LAST)


def exchange(text: str, spans: list[tuple[int, int, str]], names: set[str], rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with the words of its names, streets and eponyms exchanged."""
    marks = [(a, b, kind) for a, b, kind in spans]
    for m in EPONYM.finditer(text):
        a, b = m.span(2) if m[2] else m.span(4)
        if not any(x < b and y > a for x, y, _ in spans):
            marks.append((a, b, "eponym"))
    parts, out, last, at = [], [], 0, 0
    for a, b, kind in sorted(marks):
        body = text[a:b]
        if kind == "name":
            swap = lambda m: m.group() if rng.random() < 0.25 else rng.choice(FIRST) if m.group() in names else surname(rng)
            body = re.sub(r"[A-ZÀ-Ý][a-zà-ÿ]{2,}", swap, body)
        elif kind == "eponym":
            body = surname(rng) if rng.random() < 0.75 else body
        elif kind == "address" and rng.random() < 0.4:
            body = re.sub(r"\A[A-Z][a-zë]+(?:straat|laan|kade|dreef|pad|plein|hof|singel|steeg|weg)\b", lambda m: rng.choice(STREETS).replace("_", " "), body)
        parts += [text[last:a], body]
        at += a - last
        if kind != "eponym":
            out.append((at, at + len(body), kind))
        at += len(body)
        last = b
    return "".join([*parts, text[last:]]), out


def _digits(form: str, rng: random.Random) -> str:
    return re.sub("0", lambda m: str(rng.randint(0, 9)), form)


def _filled(template: str, rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A template with its places filled, and its spans."""
    out, spans = "", []
    part = lambda: rng.choice(["van der ", "van den ", "van de ", "van ", "de ", "den ", "ter ", "te ", "", "", "", ""])
    initials = lambda: "".join(rng.choice("ABCDEFGHJKLMNPRSTVW") + "." for _ in range(rng.randint(1, 3)))
    first = lambda: rng.choice(FIRST) if rng.random() < 0.8 else made_up(rng)
    for piece in re.split(r"(\{\w\})", template):
        kind, body = None, piece
        if piece in ("{N}", "{n}"):
            kind, body = "name", f"{first()} {part()}{surname(rng)}"
        elif piece == "{F}":
            kind, body = "name", first()
        elif piece in ("{L}", "{l}"):
            kind, body = "name", surname(rng)
        elif piece == "{P}":
            kind, body = "name", part() + surname(rng)
        elif piece == "{I}":
            kind, body = "name", initials()
        elif piece == "{C}":
            kind, body = "name", surname(rng).upper()
        elif piece == "{X}":
            body = surname(rng)
        if piece in ("{n}", "{l}"):
            body = body.lower()
        if kind == "name" and spans and spans[-1][2] == "name" and out[spans[-1][1] :] in (" ", ", "):  # initials belong to the name
            out += body
            spans[-1] = (spans[-1][0], len(out), "name")
            continue
        if kind:
            spans.append((len(out), len(out) + len(body), kind))
        out += body
    return out, spans


def snippet(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """One made-up sentence."""
    draw = rng.random()
    if draw < 0.42:
        return _filled(rng.choice(PERSONS), rng)
    if draw < 0.64:
        return _filled(rng.choice(OTHERS).replace("{T}", rng.choice(TOWNS)), rng)
    if draw < 0.80:
        body = rng.choice(ABROAD).replace("_", " ") if rng.random() < 0.25 else f"{rng.choice(STREETS).replace('_', ' ')} {rng.randint(1, 300)}{rng.choice(['', '', '', 'a', 'b', '-2', ' bis', ' hs'])}"
        if body[0].isupper() and rng.random() < 0.3:
            body += f", {_digits('0000', rng)} {rng.choice(['AB', 'XK', 'CD'])}" + (f" {rng.choice(TOWNS)}" if rng.random() < 0.6 else "")
        kind, form, mark = "address", rng.choice(PLACES), "{S}"
    elif draw < 0.87:
        body = _digits(rng.choice(["06-00000000", "06 00 00 00 00", "0600000000", "+31 6 00000000", "+31(0)20 000 0000", "020-0000000", "(030) 000 00 00", "+49 30 0000000", "0031-6-00000000", "06.00.000.000"]), rng)
        kind, form, mark = "phone", rng.choice(NUMBERS), "{T}"
    elif draw < 0.93:
        body = _digits(rng.choice(["900000000", "900 000 000", "9000.00.000", "P00000000", "XXA0B0000", "9000000", "900.0000"]), rng)
        kind, form, mark = "idnum", rng.choice(IDS), "{B}"
    else:
        who, host = f"{rng.choice(FIRST)}{rng.choice(['.', '_', ''])}{rng.choice(LAST)}".lower(), rng.choice(["example.org", "mail.example.nl", "post.test", "example.com"])
        at = rng.choice(["@", "@", "@", "(at)", "[at]", " (at) ", " [at] "])
        body = who + at + (host if "at" not in at or rng.random() < 0.5 else host.replace(".", rng.choice(["[punt]", "(punt)", "[dot]", "(dot)"])))
        kind, form, mark = "email", rng.choice(MAILS), "{M}"
    a = form.index(mark)
    return form.replace(mark, body), [(a, a + len(body), kind)]


def made_window(clean: list[str], rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """Made-up sentences between stretches of texts that hold no span."""
    out, spans = "", []
    for _ in range(rng.randint(1, 3)):
        if rng.random() < 0.7:
            t = rng.choice(clean)
            a = rng.randrange(max(1, len(t) - 60))
            out += re.sub(r"\A\S+\s|\s\S*\Z", "", t[a : a + rng.randint(15, 60)]) + rng.choice([". ", "\n", " ", ", "])
        body, mine = snippet(rng)
        case = rng.random()
        body = body.lower() if case < 0.06 and not any(k == "name" for *_, k in mine) else body.upper() if case > 0.97 else body
        spans += [(len(out) + a, len(out) + b, k) for a, b, k in mine]
        out += body + rng.choice([" ", "\n", ". ", ""])
    return out, spans


def label_ids(length: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(length, np.int8)
    for a, b, kind in spans:
        k = KINDS.index(kind)
        y[a:b] = FREE + k
        y[a] = 1 + k
    return y


def _seen(args: tuple[str, list[str]]) -> list[list[tuple[int, int, str]]]:
    return pii.Finder(args[0]).find(args[1])


def strays(texts: list[str], labeller: Labeller, weights: str) -> dict[str, list[int]]:
    """Places in each text at which the weights see a span that overlaps no label of its kind, or miss one."""
    parts = [texts[i : i + 500] for i in range(0, len(texts), 500)]
    with Pool(WORKERS) as pool:
        seen = [s for part in pool.map(_seen, [(weights, p) for p in parts], chunksize=1) for s in part]
    out = {}
    for t, found in zip(texts, seen):
        spans = labeller.spans(t)
        odd = [a for a, b, k in found if not any(s < b and e > a and k == kind for s, e, kind in spans)]
        odd += [s for s, e, kind in spans if not any(s < b and e > a and k == kind for a, b, k in found)]
        if odd:
            out[t] = odd
    return out


def pieces(codes: np.ndarray) -> list[tuple[int, int]]:
    """The units of a text, long ones in overlapping pieces of at most LENGTH."""
    ends = [0, *pii.unit_ends(codes, np.zeros(1, np.int64)).tolist(), len(codes)]
    return [(s, min(s + LENGTH, b)) for a, b in zip(ends, ends[1:]) if a < b for s in range(a, max(a + 1, b - 32), LENGTH - 32)]


def windows_of(texts: list[str], labeller: Labeller, rng: random.Random, limit: int, stray: dict[str, list[int]] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Windows of class ids and labels; with ``stray`` only those around its places."""
    xs, ys = [], []
    for t in texts:
        if len(xs) >= limit:
            break
        odd = (stray or {}).get(t, [])
        if stray is not None and not odd:
            continue
        spans = labeller.spans(t)
        if stray is None and rng.random() < 0.5:
            t, spans = exchange(t, spans, labeller.names, rng)
        y, x = label_ids(len(t), spans), encode(t)
        for s, e in pieces(x):
            held = any(s <= a < e for a in odd) if stray is not None else any(a < e and b > s for a, b, _ in spans) or rng.random() < BARE
            if held:
                xs.append(x[s:e])
                ys.append(y[s:e])
    return xs[:limit], ys[:limit]


def padded(xs: list[np.ndarray], ys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros((len(xs), LENGTH), np.uint8), np.zeros((len(xs), LENGTH), np.int8)
    for i, (a, b) in enumerate(zip(xs, ys)):
        n = min(len(a), LENGTH)
        x[i, :n], y[i, :n] = a[:n], b[:n]
    return x, y


def train(model: BiLstmCrf, x: np.ndarray, y: np.ndarray, steps: int, rate: float, batch: int = 96) -> BiLstmCrf:
    """Adam with a falling rate over a fixed number of steps."""
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    rng, began, losses, queue = np.random.default_rng(SEED), time.time(), [], []
    size = LENGTH - (x[:, ::-1] > 0).argmax(1)
    for step in range(1, steps + 1):
        if not queue:  # windows of like length go together
            some = rng.permutation(len(x))[: 40 * batch]
            queue = np.array_split(some[np.argsort(size[some], kind="stable")], max(1, len(some) // batch))
            queue = [queue[i] for i in rng.permutation(len(queue))]
        at = queue.pop()
        xb, yb = x[at, : size[at].max()].T.copy(), y[at, : size[at].max()].T.copy()
        noise = (rng.random(xb.shape) < 0.01) & (xb > 64)
        xb[noise] = rng.integers(97, 123, int(noise.sum()))
        loss, grads = model.loss_and_grads(xb, yb)
        losses.append(loss)
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values()))
        now = rate * (1 - step / steps) + 1e-5
        for k, g in grads.items():
            g = (g * min(1.0, 1.0 / (norm + 1e-9))).astype(np.float32)
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            model.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
        if step % 500 == 0:
            print(f"step {step} loss {np.mean(losses[-500:]):.5f} {time.time() - began:.0f}s", flush=True)
    return model


def texts_in(directories: list[str], limit: int = TEXTS) -> list[tuple[str, str]]:
    """At most ``limit`` texts of each table, in the order of a hash, with their language; 'report' for reports."""
    import duckdb

    out: list[tuple[str, str]] = []
    for d in directories:
        for table, column in (("documents", "text"), ("radiology_reports", "content_attachment1_plain_data")):
            path = f"{d}/{table}.parquet"
            path = f"{path}/*.parquet" if os.path.isdir(path) else path
            if glob.glob(path):
                lang = "coalesce(lang, 'nl')" if table == "documents" else "'report'"
                out += duckdb.sql(f"select {column}, {lang} from '{path}' where {column} is not null order by md5({column}), 2 limit {limit}").fetchall()
    return out


def accuracy(tag: pii.Finder, texts: list[str], labeller: Labeller) -> None:
    hit: dict[str, list[int]] = {k: [0, 0, 0] for k in KINDS}
    for t, spans in zip(texts, tag.find(texts)):
        want, got = {s[2] for s in labeller.spans(t)}, {s[2] for s in spans}
        for k in KINDS:
            hit[k][0] += k in want and k in got
            hit[k][1] += k in got and k not in want
            hit[k][2] += k in want and k not in got
    for k, (both, extra, missed) in hit.items():
        print(f"{k}: precision {both / max(1, both + extra):.4f} recall {both / max(1, both + missed):.4f} of {both + missed} records", flush=True)


def main(args: list[str]) -> None:
    out = args[args.index("--out") + 1] if "--out" in args else pii.WEIGHTS
    texts = texts_in([a for a in args if os.path.isdir(a)])
    rng = random.Random(SEED)
    rng.shuffle(texts)
    labeller = Labeller([t for t, _ in texts])
    print(len(texts), "texts;", len(labeller.names), "first names", flush=True)
    held, rest = [t for t, _ in texts[: len(texts) // 20]], texts[len(texts) // 20 :]
    groups = ([t for t, k in rest if k not in ("nl", "report")], [t for t, k in rest if k == "nl"], [t for t, k in rest if k == "report"])
    xs, ys = [], []
    for g in groups:
        a, b = windows_of(g, labeller, rng, SAMPLE // 3)
        xs, ys = xs + a, ys + b
    clean = [t for t, _ in rest[:6000] if len(t) > 80 and not labeller.spans(t)]
    for _ in range(MADE):
        t, spans = made_window(clean, rng)
        code, label = encode(t), label_ids(len(t), spans)
        for a, b in pieces(code):
            xs.append(code[a:b])
            ys.append(label[a:b])
    x, y = padded(xs, ys)
    print(len(x), "windows;", {LABELS[i]: int((y == i).sum()) for i in range(len(LABELS))}, flush=True)
    model = train(BiLstmCrf.fresh(HIDDEN, seed=SEED), x, y, STEPS[0], 0.006)
    model.save(out)
    accuracy(pii.Finder(out), held, labeller)
    for steps in STEPS[1:]:
        odd = strays([t for t, _ in rest], labeller, out)
        mx, my = windows_of([t for t, _ in rest], labeller, rng, SAMPLE // 3, odd)
        print(len(mx), "windows with strays", flush=True)
        if mx:
            px, py = padded(mx * 3, my * 3)
            x, y = np.concatenate([x, px]), np.concatenate([y, py])
        model = train(model, x, y, steps, 0.003)
        model.save(out)
        accuracy(pii.Finder(out), held, labeller)


if __name__ == "__main__":
    main(sys.argv[1:])

"""Trains the tagger: ``python -m millrace.llm.train_tagger [SECONDS] [--warm]`` writes ``tagger.npz`` beside this file.

All training lines are written here, so their spans are known as they are written: values of each kind are put together from
parts of many languages and forms, and set into containers that source control, code, data files and letters have (trailers,
comments, assignments, markup, rows, prose). Lines without personal information are written by rules as well: code, hashes,
dates, versions, number groups that are no phone or identity number, capitalised and shouted prose, addresses of repositories.
Plain words come from the vocabulary file of a public tokenizer. No document is read and no pattern labels anything.
"""

from __future__ import annotations

import base64
import random
import sys
import time

import numpy as np

from millrace.llm import tagger as T

#: A vocabulary of a public tokenizer, the source of plain words.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LENGTH = 112

Line = tuple[str, list[tuple[int, int, str]]]

# Given names in use in many languages; some are plain words as well.
FIRST = (
    "Ada Adam Agnes Ahmed Aiko Aisha Alan Alba Aleksander Alice Amara Ana Anders André Anna Antonio Arjun Astrid Ayşe Beatriz Ben Bjarne Boris Brigitte Bruno Carla Carmen Cecilia Chen Chiara "
    "Chloé Clara Daniel Dario David Deepa Diego Dmitri Edith Elena Elif Elsa Emeka Emil Emma Enzo Erik Esra Eva Farid Fatima Felix Fiona Francesca Frank Freya Gabriel Georg Giulia Grace Greta "
    "Hamid Hana Hans Hassan Heidi Helen Hiroshi Ian Ibrahim Ida Igor Ines Inês Ingrid Irene Isabel Ivan Jack Jakub James Jan Javier Jean Jens Joana Johan John Jonas Jorge José Julia Kaito Karim "
    "Karin Katarzyna Kenji Kofi Kwame Lars Laura Leila Leo Li Lin Linda Lucia Luis Łukasz Magda Maja Marek Maria Mark Marta Mateo Mateusz Matilda Maya Mei Miguel Milan Mina Mohammed Monika "
    "Nadia Naoko Nina Nkechi Noor Nora Olaf Olga Omar Oscar Pablo Paul Pavel Pedro Petra Pierre Priya Rachel Radek Rafael Rahul Raj Rosa Rose Ruth Sakura Salma Sara Selin Sergei Sofia Søren "
    "Stefan Sven Tamás Tanja Tara Teresa Thandiwe Theo Thomas Tomás Ulla Vera Viktor Wei Will Xavier Yara Yuki Yusuf Zofia Zoltán Hope Faith Grant Bill Art Rob Pat Sue Dawn Drew Chase May Joy"
).split()
CYRILLIC_FIRST = "Иван Мария Олег Анна Пётр Ольга Сергей Елена".split()
_STREET_TYPES = "Street St. St Avenue Ave. Ave Road Rd. Rd Drive Dr. Dr Lane Ln Court Ct. Boulevard Blvd Place Pl. Square Terrace Way Crescent Parkway Highway".split()
_UI = "Grid View Table Index Mode Period Page Tree Record Field Key Block Complete Candidate Descriptor Button Panel Window Filter Value Report Name Number Type Status Header".split()


def plain_words(path: str = VOCABULARY) -> list[str]:
    """Lower-case words of three letters and more that a vocabulary holds with a leading blank."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f]
    return sorted({t[1:].decode() for t in tokens if len(t) >= 4 and t[:1] == b" " and t[1:].isalpha() and t[1:].isascii() and t[1:].islower()})


class Writer:
    def __init__(self, words: list[str], seed: int = 1):
        self.r, self.words = random.Random(seed), words

    def d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def hex(self, n: int) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(n))

    def word(self) -> str:
        return self.r.choice(self.words)

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.r.choice(("the", "a", "of", "to", "in", "for", "no", "is", "was", "and", "that", "with")) if self.r.random() < 0.3 else self.word() for _ in range(self.r.randint(low, high)))

    def syllables(self, low: int = 2, high: int = 3) -> str:
        r = self.r
        onset = ("b c d f g h k l m n p r s t v w z j br cr dr fr gr kr pr tr bl fl gl kl pl sl st sk sp sv ch sh th kh zh qu y").split()
        nucleus = ("a e i o u a e i o u ai au ei eu ia ie io oa ou ua ü ö é á ø").split() if r.random() < 0.25 else ("a e i o u a e i o u ai au ei ia io ou ua").split()
        coda = ["", "", "", "l", "n", "r", "s", "m", "t", "k", "nd", "rt", "ns", "ck", "ll", "ng", "sk", "b", "d", "g", "v", "z"]
        return "".join(r.choice(onset) + r.choice(nucleus) + (r.choice(coda) if k or r.random() < 0.5 else "") for k in range(r.randint(low, high)))

    def surname(self) -> str:
        r, x = self.r, self.r.random()
        s = self.syllables() + r.choice(["", "", "", "", "", "ov", "ski", "sen", "son", "ez", "ini", "er", "mann", "ard", "us", "ic", "ell", "ow", "is", "ko", "wa", "ey", "ides", "ian"])
        if x < 0.08:
            s = self.word()
        s = s.capitalize()
        return f"{r.choice(['Mc', 'Mac', 'O’', chr(79) + chr(39), 'De', 'Van', 'Fitz'])}{s}" if x > 0.96 else f"{s}-{self.syllables(2, 3).capitalize()}" if x > 0.92 else s

    def person(self) -> str:
        r = self.r
        if r.random() < 0.03:
            stem = "".join(r.choice(("ко", "ва", "ле", "ни", "мо", "ру", "та", "сте", "пе", "гри")) for _ in range(r.randint(2, 3))).capitalize()
            return f"{r.choice(CYRILLIC_FIRST)} {stem}{r.choice(('в', 'нко', 'ва', 'ев'))}"
        first = r.choice(FIRST) if r.random() < 0.85 else self.syllables(1, 3).capitalize()
        last = self.surname()
        if r.random() < 0.06:
            first = f"{first}-{r.choice(FIRST)}"
        x = r.random()
        if x < 0.62:
            name = f"{first} {last}"
        elif x < 0.72:
            name = f"{first} {r.choice('ABCDEFGHJKLMNPRSTW')}. {last}"
        elif x < 0.82:
            name = f"{first[0]}. {last}"
        elif x < 0.9:
            name = f"{last}, {first}" + (f" {r.choice('ABCDEM')}." if r.random() < 0.15 else "")
        elif x < 0.95:
            name = f"{first} {r.choice(['van', 'von', 'de', 'da', 'del', 'di', 'la', 'van der', 'bin', 'al'])} {last}"
        else:
            name = f"{first} {r.choice(FIRST)} {last}"
        return name.upper() if r.random() < 0.07 else name

    def host(self) -> str:
        r = self.r
        parts = [r.choice(["mail", "post", "lab", "uni", "dev", "corp", "smtp", self.word(), self.syllables(2, 3)]) for _ in range(r.choice((1, 1, 1, 2)))]
        parts = ["".join(c for c in p.lower() if c.isascii()) or "host" for p in parts]
        return ".".join([*parts, r.choice(["example", self.word()])]) + "." + r.choice("com org net edu de fr io co test example info eu it se pl".split()) if r.random() < 0.6 else f"{r.choice(parts)}{r.choice(['', '-' + self.word()])}.{r.choice('com org net edu de fr io test example eu it se pl co.uk'.split())}"

    def email(self) -> str:
        r = self.r
        first, last = r.choice(FIRST), self.surname()
        user = r.choice([f"{first}.{last}", f"{last}_{first}", f"{first[0]}{last}", f"{first}{self.d(2)}", f"{first}.{last}+{self.word()}", f"{last}", f"{first[0]}.{last}", f"{first}-{last}", f"{self.word()}{self.d(r.randint(0, 3))}", f"{first}.{last[0]}"]).lower()
        user = "".join(c for c in user if c.isascii() and (c.isalnum() or c in "._+-")).strip("._+-") or "user"
        host, x = self.host(), r.random()
        if x < 0.6:
            return f"{user}@{host}".upper() if r.random() < 0.12 else f"{user}@{host}"
        at = r.choice(["(at)", " (at) ", "[at]", " [at] ", " at ", "{at}"])
        dot = r.choice([".", " dot ", "[dot]", " [dot] ", "(dot)", " (dot) "])
        if at == " at " and dot == ".":
            dot = " dot "
        return f"{user.replace('.', dot) if r.random() < 0.4 else user}{at}{host.replace('.', dot)}"

    def phone(self) -> str:
        r = self.r
        a, b, c = r.choice("23456789") + self.d(2), r.choice((self.d(3), "555")), self.d(4)
        x = r.random()
        if x < 0.7:
            core = r.choice([f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+1-{a}-{b}-{c}", f"+1 {a} {b} {c}", f"+1 ({a}) {b}-{c}", f"1 ({a}) {b} {c}", f"1-{a}-{b}-{c}", f"{a}{b}{c}", f"{a}{b}{c}", f"{a}.{b}.{c}", f"+1{a}{b}{c}", f"+1.{a}.{b}.{c}"])
        elif x < 0.85:
            core = r.choice([f"0{r.randint(1, 9)}{self.d(3)} {self.d(6)}", f"+44 {self.d(4)} {self.d(6)}", f"020 {self.d(4)} {self.d(4)}", f"+44 20 {self.d(4)} {self.d(4)}", f"0{self.d(4)}-{self.d(6)}"])
        else:
            core = f"+{r.choice('33 34 39 41 46 47 48 49 61 81 86 91 351 420'.split())}{r.choice([' ', '-', ' ('])}{self.d(r.randint(2, 3))}"
            core += (")" if "(" in core else "") + "".join(r.choice(" -") + self.d(r.randint(2, 4)) for _ in range(r.randint(2, 3)))
        return core + (r.choice([" ext. ", " ext ", " x", ", ext. ", " x ", " extension "]) + self.d(r.randint(2, 4)) if r.random() < 0.12 else "")

    def identity(self) -> str:
        r, up = self.r, "ABCDEFGHJKLMNPQRSTUVWXYZ"
        two = r.choice(up) + r.choice(up)
        return r.choice([f"{self.d(3)}-{self.d(2)}-{self.d(4)}", f"{self.d(3)}-{self.d(2)}-{self.d(4)}", f"{self.d(3)} {self.d(2)} {self.d(4)}", f"{two}{self.d(6)}{r.choice('ABCD')}", f"{two} {self.d(2)} {self.d(2)} {self.d(2)} {r.choice('ABCD')}", f"{two}{self.d(7)}", f"{two} {self.d(7)}"])

    def address(self) -> str:
        r, x = self.r, self.r.random()
        town = r.choice([self.syllables(2, 3).capitalize() + r.choice(["ford", "burg", "haven", "moor", "ton", "ville", "bridge", "mouth", "field", "dale", "", "", "stead"]), f"{r.choice(['Port', 'New', 'Lake', 'Saint', 'North'])} {self.surname()}"])
        if x < 0.1:
            core = f"{r.choice(['P.O. Box', 'PO Box', 'P. O. Box', 'Post Office Box'])} {r.randint(1, 9999)}"
        elif x < 0.2:
            road = r.choice([self.syllables(2, 3).capitalize() + r.choice(["straße", "strasse", "gatan", "weg", "gasse", "gade", "laan"]) + f" {r.randint(1, 200)}", f"{r.randint(1, 200)} rue {r.choice(['de', 'du', 'de la'])} {self.surname()}", f"{r.choice(['Calle', 'Via', 'Rua', 'Avenida'])} {self.surname()} {r.randint(1, 200)}"])
            return road + (f", {self.d(5)} {town}" if r.random() < 0.6 else "")
        else:
            name = r.choice([self.word().capitalize() + r.choice("field view ridge brook stone gate crest wood hurst mere dale ton side".split()), self.word().capitalize(), self.surname(), f"{r.choice(['Fort', 'Mount', 'Old', 'Saint', 'High', 'Upper'])} {self.surname()}", f"{r.randint(1, 130)}{r.choice(['th', 'th', 'st', 'nd', 'rd'])}"])
            core = f"{r.randint(1, 13000)}{r.choice(['', '', '', '', 'B'])} {r.choice(['', '', '', 'N. ', 'S. ', 'North ', 'South ', 'West ', 'East ', 'W ', 'E '])}{name} {r.choice(_STREET_TYPES)}{r.choice(['', '', '', '', ' N', ' West'])}"
            if r.random() < 0.22:
                core += f"{r.choice([', ', ' ', ', '])}{r.choice(['Unit ', 'Apt ', 'Apt. ', 'Suite ', 'Ste. ', '#', 'Floor ', 'Room '])}{r.randint(1, 399)}{r.choice(['', '', 'B'])}"
        if r.random() < 0.5:
            core += f", {town}"
            if r.random() < 0.5:
                core += f"{r.choice([', ', ', ', ' '])}{r.choice('AL AK AZ CA CO CT FL GA IA ID IL KS KY MA ME MI MN NV NY OH OR PA TN TX UT VA WA WI'.split())}{r.choice([' ' + self.d(5), ' ' + self.d(5), ' ' + self.d(5) + '-' + self.d(4), ''])}"
        return core

    def value(self, kind: str) -> str:
        return {"person_name": self.person, "email": self.email, "phone": self.phone, "id_number": self.identity, "street_address": self.address}[kind]()

    def lead(self) -> str:
        return self.r.choice(["", "", "", "", "+", "-", " ", "    ", "    ", "    ", "        ", "+    ", "-    ", "\t", "* ", " * ", "// ", "    // ", "# ", "    # ", "/* ", "-- ", "> ", "+// ", "+# ", "- ", "    - "])

    KEYS = {
        "person_name": "author name owner contact user maintainer reviewer reporter editor assignee signed manager".split(),
        "email": "mail email e-mail contact notify owner to cc from support sender reply_to".split(),
        "phone": "tel phone fax mobile call hotline contact number telephone cell".split(),
        "id_number": "ssn id passport nino id_no insurance tax_id document national_id number".split(),
        "street_address": "address street office location ship_to site home billing addr".split(),
    }
    CUES = {
        "person_name": ["thanks to", "reported by", "suggested by", "found by", "as", "with", "for", "per", "by", "from", "cc", "ping", "asked", "credit to", "review by", "spotted by", "after", "see", "paired with", "works for", "patch from", "idea of", "contact"],
        "email": ["write to", "mail", "ping", "send it to", "reach me at", "contact", "reply to", "sent by", "from", "via", "ask", "cc", "address is"],
        "phone": ["call", "tel", "phone", "fax", "reached on", "hotline is", "dial", "text", "number", "at", "mobile", "ring", "Tel:", "Phone:", "was"],
        "id_number": ["SSN", "passport", "insured as", "ID", "ID no.", "number", "holder of", "document", "the record of", "NINO", "tax id", "with id", "customer"],
        "street_address": ["ships to", "office at", "moved from", "lives at", "located at", "was", "send to", "the record for", "address", "site", "opposite", "deliver to", "Office:", "visit"],
    }

    def contained(self, kind: str) -> Line:
        """One line with a value of the kind."""
        r, v = self.r, self.value(kind)
        spans: list[tuple[str, str]] = [(kind, v)]
        x = r.random()
        if kind in ("person_name", "email") and x < 0.3:
            label = r.choice("Author Author Author Committer Commit From To Cc Signed-off-by Reviewed-by Acked-by Tested-by Reported-by Co-authored-by Suggested-by Helped-by By".split())
            before = r.choice(["", "", "    "]) + label + r.choice([": ", ": ", ":  ", " "])
            name = self.person() if r.random() < 0.7 else r.choice([self.word(), self.syllables(2, 3) + self.d(2)])
            mail = self.email()
            parts = [before, ("person_name", name) if any(c.isupper() for c in name) and " " in name else name]
            parts += [" <", ("email", mail), ">"] if r.random() < 0.8 else []
            return self.join(parts)
        key = r.choice(self.KEYS[kind])
        if x < 0.55:
            k = r.choice([key, key.capitalize(), f"{self.word()}_{key}", f"{self.word()}{key.capitalize()}"])
            parts = r.choice([
                [self.lead(), f'{k} = "', 0, '"'], [self.lead(), f"{k}: ", 0], [self.lead(), f'"{k}": "', 0, '",'], [self.lead(), f'{{"{k}": "', 0, '"},'], [self.lead(), f"<{self.word()} {k}=\"", 0, '"/>'],
                [self.lead(), f"<{key}>", 0, f"</{key}>"], [self.lead(), f"{self.word()}({k}='", 0, "')"], [self.lead(), f"expect({self.word()}[{r.randint(0, 9)}]).toBe('", 0, "')"], [self.lead(), f"set_{key}(\"", 0, '");'], [self.lead(), f"{k}=", 0],
            ])
        elif x < 0.7:
            sep = r.choice([";", "|", "\t", ","]) if kind not in ("street_address",) and "," not in v else r.choice([";", "|", "\t"])
            cells = [r.choice([self.word(), self.d(r.randint(1, 4)), f"{r.choice('ABCX')}{self.d(4)}", "Y", "", self.word()]) for _ in range(r.randint(0, 2))]
            after = [r.choice([self.word(), self.d(2), "Y", "A", ""]) for _ in range(r.randint(0, 3))]
            parts = [r.choice(["", "+", "-", " "]), "".join(c + sep for c in cells), 0, "".join(sep + c for c in after)]
            if r.random() < 0.2:
                parts = [self.lead(), f"INSERT INTO {self.word()} VALUES ({r.randint(1, 99)}, '", 0, f"', {r.randint(0, 9)});"]
        elif x < (0.86 if kind == "person_name" else 0.93):
            cue = r.choice(self.CUES[kind])
            cue = cue.capitalize() if r.random() < 0.4 else cue
            before = [self.lead(), self.prose(1, 4) + " " if r.random() < 0.4 else "", cue + r.choice([" ", " ", ": "])]
            if kind == "person_name" and r.random() < 0.1:
                before.append(r.choice(["Dr. ", "Mr. ", "Mrs. ", "Ms ", "Prof. "]))
            wrap = r.choice([("", ""), ("", ""), ("", ""), ("(", ")"), ('"', '"'), ("<", ">"), ("'", "'")])
            tail = r.choice(["", "", ".", ",", f" {self.prose(1, 5)}", f" {self.prose(1, 5)}.", f", {self.prose(1, 4)}", f" and {self.prose(1, 3)}", " */"])
            parts = [*before, wrap[0], 0, wrap[1], tail]
        elif kind == "person_name" and x < 0.97:  # a name in a sentence of its own
            verb = r.choice("reviewed discussed tested written checked agreed shared paired traced signed worked seen".split())
            parts = r.choice([
                [self.lead(), f"{verb.capitalize()} with ", 0, f" {self.prose(1, 3)}"], [self.lead(), f"{w}-{verb} with ", 0] if (w := self.word()) else [], [self.lead(), 0, f" {r.choice('asked said noticed wrote found wants reported prefers confirmed called saw thinks fixed broke owns tested'.split())} {r.choice(['for', 'that', 'this', 'it', 'about', 'to'])} {self.prose(1, 3)}"],
                [self.lead(), "as ", 0, f" {r.choice('noticed said found wrote pointed asked reported'.split())} {self.prose(1, 3)}"], [self.lead(), r.choice(["thanks to ", "Thanks to ", "kudos to ", "credit to "]), 0, f" {r.choice(['for', 'and', 'who'])} {self.prose(1, 3)}"],
            ])
        elif kind == "person_name":
            parts = [self.lead(), r.choice(["", "TODO(", "@author ", "Copyright 2016 ", "(c) 2014 ", "/* ", "Dr. ", "-- "]), 0]
            parts.append(")" if parts[1] == "TODO(" else f" {r.choice('asked said noticed wrote found wants reported prefers confirmed called saw thinks fixed broke owns tested'.split())} {self.prose(1, 5)}" if r.random() < 0.7 else r.choice([f" {r.randint(1990, 2026)} */", ":", "'s patch", f", {self.prose(1, 3)}"]))
        else:
            parts = [self.lead(), 0, r.choice(["", f" {self.prose(1, 5)}", ".", f" is {self.prose(1, 4)}"])]
        return self.join([spans[0] if p == 0 else p for p in parts])

    @staticmethod
    def join(parts) -> Line:
        text, spans = "", []
        for p in parts:
            if isinstance(p, tuple):
                spans.append((len(text), len(text) + len(p[1]), p[0]))
                text += p[1]
            else:
                text += p
        return text, spans

    def nothing(self) -> str:
        """One line that holds nothing personal."""
        r, w, title = self.r, self.word, lambda: self.word().capitalize()
        x = r.random()
        ident = lambda: r.choice([w() + title(), f"{w()}_{w()}", title() + title(), "_" + w() + title(), w()])
        if x < 0.16:
            return self.lead() + r.choice([
                f"{ident()}({ident()}, {r.randint(0, 4000)});", f"for (var i = {r.randint(0, 9)}; i < {ident()}; i++) {{", f"private readonly int {ident()};", f'throw new {title()}{title()}Exception("{self.prose(1, 3)} {self.d(4)}");', f"@{w()}.{w()}('{w()}/{w()}')",
                f"def {ident()}(self, {w()}, size={r.randint(1, 4000)}):", f'"{w()}": {r.randint(1, 9000)},', f"return self.{w()}.{w()}({r.randint(1, 9)})", f"if ({ident()} < {r.randint(1, 400)}) return {r.randint(0, 3)};", f"byte[] {ident()} = {ident()}({r.randint(1, 5000)});", f"import {w()}.{w()};", f"class {title()}{title()} extends {title()} {{", f"{title()}.{title()} = new {title()}({r.randint(0, 99)});",
            ])
        if x < 0.34:
            return r.choice([
                f"index {self.hex(7)}..{self.hex(7)} 100644", f"@@ -{r.randint(1, 900)},{r.randint(1, 9)} +{r.randint(1, 900)},{r.randint(1, 9)} @@ {r.choice(['', ident()])}", f"diff --git a/{w()}/{ident()}.py b/{w()}/{ident()}.py", f"commit {self.hex(40)}", f"From {self.hex(40)}", f"Date:   20{self.d(2)}-{self.d(2)}-{self.d(2)} {self.d(2)}:{self.d(2)}:{self.d(2)} +0{r.randint(0, 9)}00", f"Author: {w()}{self.d(r.randint(0, 2))}", f"Author: {w()}-{r.choice(['bot', 'robot', 'ci'])}", f"From: {r.choice([w(), self.syllables(2, 3)])}{self.d(2)}",
                f"Merge branch '{w()}/{w()}-{w()}' into {w()}", f"Binary files a/{w()}.png and b/{w()}.png differ", f"    This reverts commit {self.hex(40)}.", f"    - {w()}{w()} {r.randint(0, 9)}.{r.randint(0, 99)}.{r.randint(0, 9)} ({self.hex(7)})", f"Date: {r.choice('Mon Tue Wed Thu Fri Sat Sun'.split())}, {r.randint(1, 31)} {r.choice('Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec'.split())} 20{self.d(2)} {self.d(2)}:{self.d(2)}:{self.d(2)} +0000", f"---- {self.d(4)}-{self.d(2)}-{self.d(2)} ----", f"r{self.d(5)} | {w()}{self.d(2)} | 20{self.d(2)}-{self.d(2)}-{self.d(2)}",
            ])
        if x < 0.38:  # versions, pictures and numbers beside words
            n, m, thing = r.randint(0, 9), r.randint(0, 999), w() + r.choice(["", w()])
            return self.lead() + r.choice([
                f"{self.prose(1, 3)} {thing}@{n}.{m}.{r.randint(0, 9)}{r.choice(['', ' ' + self.prose(1, 4), '.'])}", f"{thing}@{r.randint(1, 40)}.{n}", f"{self.prose(1, 3)} {w()}/{thing}@{r.choice('123')}x.{r.choice(['png', 'jpg', 'svg', 'gif'])}{r.choice(['', '.'])}", f"{title()} git@{thing}.{r.choice(['example', 'com', 'test'])}:{w()}/{w()}.git {self.prose(1, 3)}.", f"{self.prose(1, 2)} {w()}@{w()}.{w()}:{w()}/{w()}.git",
                f"{m} {r.choice(_STREET_TYPES)} {self.prose(1, 5)}{r.choice(['', '.'])}", f"{title()} {m} {self.prose(1, 3)}", f"{self.prose(1, 3)} {m} {self.prose(1, 3)}.", f"{self.prose(1, 4)} is {m}", f"{title()} {title()} {n} {self.prose(0, 2)}", f"{m} {title()} {self.prose(1, 4)}.", f"{m} {title()} {title()} {self.prose(1, 3)}", f"{m}.{n}.{n} {self.prose(0, 3)}", f"{m}, {n}, {m + 3}", f"-----{r.choice(['BEGIN', 'END'])} {w().upper()} {r.choice(['KEY', 'CERTIFICATE', w().upper()])}-----", f"{title()} {w()[:3].upper()}-{self.d(3)}-{self.d(5)}, {w()} {self.d(8)}.", f"{title()} {self.d(r.choice((8, 9, 10, 11)))} {w()}.", f"{self.prose(1, 3)} {r.randint(10, 999)} {w()} {w()} at {n} o'clock. {title()} {r.randint(2, 60)} {w()}", f"[{n}, {m}, {r.randint(1, 99)}] {w()}",
            ])
        if x < 0.55:  # number groups and signs that resemble the kinds
            n, m = r.randint(1, 9), r.randint(10, 999)
            return self.lead() + r.choice([
                f"{title()} {self.prose(1, 3)} {self.d(3)}.{self.d(3)}.{self.d(4)}.{n} {self.prose(1, 3)}", f"{title()} {self.d(3)}-{self.d(2)}-{self.d(5)} {self.prose(1, 3)}", f"{title()} {w()} {self.d(3)}-{self.d(2)}-{self.d(6)} {self.prose(1, 2)}.", f"{title()} {self.d(3)}.{self.d(3)}.{self.d(4)}{n}.{n} {self.prose(1, 3)}.", f"{title()} {r.randint(10, 250)}.{r.randint(0, 250)}.{r.randint(0, 250)}.{r.randint(0, 999)} {self.prose(1, 3)}.", f"{w()}@{n}.{m}.{n} {self.prose(0, 3)}", f"{self.prose(1, 3)} {w()}{w()}@{n}.{m}.0", f"git@{w()}.{r.choice(['example', 'com', 'org'])}:{w()}/{w()}.git {self.prose(0, 3)}", f"{self.prose(1, 3)} git@{w()}.example:{w()}/{w()}.git",
                f"{self.prose(1, 3)} {w()}/{w()}@{r.choice('23')}x.png", f"{self.prose(1, 3)} {w()}@{w()}.{w()}:{w()}/{w()}", f"{title()} {r.randint(100, 9999)}-{r.randint(100, 99999)} {self.prose(1, 4)}.", f"{title()} {r.randint(100, 9999)}-{r.randint(100, 99999)}, {title()} {title()} {n}.", f"{title()} {w()} {self.d(5)}-{self.d(3)}, {self.prose(1, 3)}", f"{title()} {m} ms before, {m + n} ms after, {self.prose(1, 4)}.", f"{self.prose(1, 4)} #{m} and r{self.d(5)}.", f"{w()} @{w()}{self.d(2)} {self.prose(0, 3)}", f"{self.hex(8)}-{self.hex(4)}-{self.hex(4)}-{self.hex(4)}-{self.hex(12)}", f'{w()} = "{self.hex(2)}{title()}{self.hex(6)}{self.d(2)}{title()}"', f"{w().upper()}_{w().upper()}={self.hex(24)}", f"token AK{self.d(4)}{self.hex(12).upper()}", f"https://{w()}.{w()}/{w()}?{w()}={self.d(5)}",
                f"ISBN {self.d(3)}-{n}-{self.d(4)}-{self.d(4)}-{n}", f"{self.d(4)}-{self.d(2)}-{self.d(2)}T{self.d(2)}:{self.d(2)}:{self.d(2)}Z {self.prose(0, 3)}", f"{self.d(3)}x{self.d(3)} {self.prose(1, 3)}", f"{self.d(1)},{self.d(3)},{self.d(3)} {self.prose(1, 3)}", f"{w()} {n}.{m}.{self.d(4)}-rc{n}", f"order {self.d(10)}{self.d(3)} {self.prose(1, 3)}", f"{self.d(16)} {self.prose(1, 2)}", f"{self.prose(1, 3)} 0x{self.hex(8)}", f"{self.prose(1, 2)} at {self.prose(1, 3)} dot {w()}", f"{self.prose(1, 3)} {r.choice(['(at)', '[at]'])} {self.prose(1, 2)}",
            ])
        if x < 0.8:  # capitals in prose
            name = r.choice(FIRST)
            thing = r.choice(_UI) if r.random() < 0.6 else title()
            return self.lead() + r.choice([
                f"{title()} {self.prose(1, 6)}", f"{title()} {self.prose(1, 5)}.", f"{name} {thing} {self.prose(1, 5)}.", f"{name} {thing} {self.prose(1, 5)}", f"{title()} {thing} {self.prose(1, 5)}", f"{title()} {name} {thing} {self.prose(1, 4)}", f"{name} {thing} and {name} {title()} {self.prose(1, 4)}.", f"{self.prose(1, 3)} {title()} {title()} {self.prose(0, 3)}.",
                f"{r.choice(_STREET_TYPES)} {thing} {self.prose(1, 4)} {r.randint(1, 999)} {self.prose(1, 3)}.", f"{r.randint(2, 99)} {r.choice(_STREET_TYPES)} {self.prose(1, 4)}.", f"{title()} {r.randint(2, 999)} {r.choice(_STREET_TYPES)} {self.prose(1, 3)}.", f"The {title()} {title()} {self.prose(1, 5)}.", f"{r.choice(_UI)} {r.choice(_UI)} {self.prose(1, 4)}.", f"{title()}, {title()} {self.prose(0, 3)}", f"{self.prose(1, 4)}: {title()} {thing}", f"Release {title()} {r.randint(1, 9)}, {title()} {r.randint(1, 99)}", f"{self.prose(1, 3)}. {title()} {self.prose(1, 4)}", f"{w()} {name} {self.prose(1, 4)}", f"{name}: {self.prose(1, 4)}", f"{name}, {self.prose(1, 4)}",
            ])
        if x < 0.93:  # shouted text
            some = [r.choice([w(), w(), w(), "the", "of", "one", "each", "a", f"({r.choice('abcd')})", str(r.randint(2, 99))]).upper() + r.choice(["", "", "", "", "", ",", "."]) for _ in range(r.randint(3, 12))]
            return r.choice(["", "* ", "# ", "+    ", "// ", " * ", "    "]) + " ".join(some)
        return r.choice(["", "    ", "+", " ", "}", "+    }", self.lead() + self.prose(1, 9)])


def written(count: int, seed: int = 3, vocabulary: str = VOCABULARY) -> list[Line]:
    """Lines with their spans, half of them with a value."""
    w = Writer(plain_words(vocabulary), seed)
    return [w.contained(w.r.choice(T.KINDS[:4] + ("person_name",) * 3)) if w.r.random() < 0.52 else (w.nothing(), []) for _ in range(count)]


def arrays(rows: list[Line], seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags (length, rows): each line by itself, padded; of longer lines a part chosen at random."""
    r = random.Random(seed)
    x, y = np.full((LENGTH, len(rows)), T.PAD, np.int16), np.zeros((LENGTH, len(rows)), np.int8)
    for j, (line, spans) in enumerate(rows):
        code, tags = T.codes(line), np.zeros(len(line), np.int8)
        for a, b, kind in spans:
            k = T.KINDS.index(kind)
            tags[a:b] = 2 * k + 2
            tags[a] = 2 * k + 1
        at = r.randint(0, max(0, len(line) - LENGTH))
        n = min(LENGTH, len(line) - at)
        x[:n, j], y[:n, j] = code[at : at + n], tags[at : at + n]
    return x, y


def main(seconds: float, rate: float = 8e-3, warm: bool = False, hidden: int = 32, lines: int = 160_000) -> None:
    rows = [row for row in written(lines, 6 if warm else 3) if row[0].strip()]
    rows.sort(key=lambda row: len(row[0]))  # batches of like length
    held = [row for row in written(4000, seed=77) if row[0].strip()]
    hx, hy = arrays(held)
    p = T.load() if warm else T.initial(hidden)
    adam = T.Adam(p, rate)
    rng = random.Random(1)
    began, k, batch = time.time(), 0, 192
    while time.time() - began < seconds:
        share = (time.time() - began) / seconds
        adam.rate = rate * (1 - share) ** 1.5 + 2e-4
        at = rng.randrange(0, len(rows) - batch)
        x, y = arrays(rows[at : at + batch], k)
        n = max(1, int((x != T.PAD).any(1).sum()))
        loss, g = T.loss_and_gradients(p, x[:n], y[:n])
        adam.step(p, g)
        k += 1
        if k % 200 == 0:
            tags = T.viterbi(T.emissions(p, hx), p["t"])
            hit = ((tags > 0) & (tags == hy)).sum()
            print(k, round(loss, 3), "characters: precision", round(hit / max((tags > 0).sum(), 1), 4), "recall", round(hit / (hy > 0).sum(), 4), round(time.time() - began), flush=True)
    np.savez_compressed(T.WEIGHTS, **{name: v.astype(np.float16) for name, v in p.items()})


if __name__ == "__main__":
    # a second run with --warm goes on from the weights of the first at a lower rate, on other lines
    main(float(sys.argv[1]) if len(sys.argv) > 1 else 600.0, 4e-3 if "--warm" in sys.argv else 8e-3, "--warm" in sys.argv)

"""Labelled texts for the mention model: invented people and places amid ordinary words of several languages, and look-alikes.

No sentence is written out whole: words, cues and mentions are drawn at random,
so that the model learns from the form of a mention and the kinds of words around
it, not from phrases.
"""

from __future__ import annotations

import random

_ONSETS = "b bl br c ch cr d dr f fl g gr h j k kl l m n p pr qu r s sh sk st t th tr v w y z".split()
_VOWELS = "a e i o u ai ea ei ou á é ö ü".split()
_CODAS = "n r l s t th nd rk lm st x ck gs ng".split()
_GIVEN = """Anna Maria John Peter Thomas Laura Oliver Emma Hannah Lukas Sofia Carlos Elena Miguel Priya Arjun Yuki Kenji Olga Ivan Fatima Omar Grace Samuel Clara
    Jonas Mia Felix Ingrid Lars Pierre Chloe Marta Pablo Diego Nadia Tom Will Mark Rose""".split()
_FAMILY = """Smith Gonzalez Becker Thornton Keller Palmer Raman Tanaka Ivanov Petrov Haddad Müller Schneider Fischer Weber García López Martín Dubois Moreau Rossi
    Bianchi Novak Kowalski Hansen Nielsen Johnson Brown Taylor Wilson Clarke Patel Singh Nguyen Grant Young Baker Hill Stone Berg Kaya Silva""".split()
_KO_FAMILY = "김이박최정강조윤장임한오서신권황안송류전홍고문손양배백허유남심노하곽성차주우구라진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모단궁갈빈온"
_KO_GIVEN = "가나다라마바사아자하누솔빛람별온찬래해민준서윤지호은수영진현우연재희경미선정아"
_KO_WORDS = "회의 자료 파일 일정 보고서 전화 메일 내일 오늘 확인 부탁 공유 완료 문서 페이지 링크 목록 어제 다음 결과".split()
_EN = """the a an this that every one no our some any of to in on at for with by from and but or when after before until while is was are were has had be been not
    still only just very more most again never always keep use make take find show move open close read write run check new old last next first late early long short
    small large full empty same other team page list note file row word line part day week year time place name number order work report letter house table window
    garden engine bridge market ticket office meeting project budget answer question reason result""".split()
_RARE = """frontmatter wikilink changelog backlog dedupe idempotent hotfix tokenizer shard ledger upsert rollback lint checksum pipeline parquet cron latency schema
    snapshot gazebo lichen tundra walrus zephyr quokka marzipan brisket trellis ottoman lattice pergola kestrel""".split()
_DE = "der die das ein eine und oder aber nicht noch schon immer nach vor bei mit ohne über unter ist war wird wurde hat sind Woche Tag Liste Seite Datei Zeile Frage Antwort Bericht Tisch Fenster Brücke Markt Abend Montag Plan Eintrag Ordner".split()
_ES = "el la los las un una y o pero no ya siempre después antes con sin sobre es era fue está día lista página archivo línea pregunta respuesta informe mesa ventana puente mercado noche semana".split()
_HEADS = """Seit Laut Trotz Nach Ohne Wegen Während Gegen Für Zwischen Die Der Das Ein Eine Jede Alle Diese Keine Unsere Según Desde Tras Cada Todo Los Las Esta Nuestra
    Every Each The This Our When Since After Before Half Nothing Never Always Keep Use Some Any No Both Most Until Without""".split()
_TITLES = "Dr. Prof. Mr. Mrs. Ms. Herr Frau Sr. Sra. Mister Doctor".split()
_BEFORE = """with by from to and for of ask tell met told asked called thank thanks hello hi dear cc ping see via like owner author signed sincerely regards contact attention
    name reviewer reported written paired c/o when says because as while that did mit von an bei für und fragt nach con de para por y""".split()
_SAID = """said wrote says asked met called sent brought found left came joined agreed thinks wants prefers put reviewed fixed moved took gave noticed explained is was has will sagte kam hat dijo""".split()
_LABELS = ("name", "owner", "author", "contact", "Name", "Author", "by", "From", "To", "user", "customer", "patient", "signed", "Reviewer", "assignee")
_ROADS = "Street Road Lane Close Avenue Drive Court Way Place Square Terrace Crescent Hill Gardens Park Grove".split()
_US_ROADS = "St Ave Blvd Rd Dr Ln Ct Pl".split()
_DE_ROADS = "straße strasse weg platz gasse allee stieg ring damm ufer bruchweg teich hofstraße".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.gold: set[tuple[int, int, str]] = set()
        self.text = ""

    # --- words

    def syllables(self, n: int) -> str:
        r = self.r
        return "".join(r.choice(_ONSETS) + r.choice(_VOWELS) + (r.choice(_CODAS) if r.random() < 0.4 else "") for _ in range(n))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self) -> str:
        r, k = self.r, self.r.random()
        if k < 0.1:
            return self.syllables(r.randint(2, 4))
        return r.choice(_RARE) if k < 0.25 else r.choice(_EN)

    def words(self, least: int, most: int) -> str:
        """A stretch of ordinary words in one language and one dress, with some marks between them."""
        r, n = self.r, self.r.randint(least, most)
        k = r.random()
        source = [self.word() for _ in range(n)] if k < 0.7 else [r.choice(_DE) for _ in range(n)] if k < 0.88 else [r.choice(_ES) for _ in range(n)]
        out = []
        for w in source:
            x = r.random()
            out.append(str(r.randint(1, 2000)) if x < 0.04 else w + r.choice((",", ";", " -", ":", ".")) if x < 0.12 else w)
        return " ".join(out)

    def dressed(self, least: int, most: int) -> str:
        text, k = self.words(least, most), self.r.random()
        return text.upper() if k < 0.15 else text.title() if k < 0.28 else text.swapcase().capitalize() if k < 0.3 else text[:1].upper() + text[1:] if k < 0.75 else text

    def nouns(self) -> str:
        return (self.syllables(2) + self.r.choice(("en", "e", "er", "s", "ung", "ungen", ""))).capitalize() if self.r.random() < 0.7 else self.word().capitalize()

    # --- mentions

    def given(self) -> str:
        r = self.r
        name = r.choice(_GIVEN) if r.random() < 0.3 else self.syllables(r.choice((1, 2, 2, 3))).capitalize()
        return f"{name}-{self.syllables(1).capitalize()}" if r.random() < 0.06 else name

    def family(self) -> str:
        r = self.r
        name = r.choice(_FAMILY) if r.random() < 0.3 else self.syllables(r.choice((2, 2, 3))).capitalize()
        k = r.random()
        return f"{name}-{self.syllables(2).capitalize()}" if k < 0.06 else f"O'{name}" if k < 0.08 else name

    def initial(self) -> str:
        return self.r.choice("ABCDEFGHIJKLMNOPRSTUVWY") + "."

    def person(self) -> str:
        r, g, f = self.r, self.given(), self.family()
        if r.random() < 0.08:
            f = r.choice(("van der", "van", "von", "de", "di")) + " " + f
        k = r.random()
        name = f"{g} {f}" if k < 0.6 else f"{self.initial()} {f}" if k < 0.68 else f"{g} {self.initial()} {f}" if k < 0.76 else f"{self.initial()} {self.initial()} {f}" if k < 0.8 else f"{f}, {g}" if k < 0.95 else f"{f}, {self.initial()}"
        k = r.random()
        return name.upper() if k < 0.12 else name.lower() if k < 0.26 else name

    def korean(self) -> str:
        return self.r.choice(_KO_FAMILY) + "".join(self.r.choice(_KO_GIVEN) for _ in range(self.r.choice((1, 2, 2, 2))))

    def host(self) -> str:
        r = self.r
        plain = self.syllables(2).encode("ascii", "ignore").decode() or "mail"
        return r.choice((f"{plain}.test", f"{plain}.org", "example.org", "example.com", f"{plain}.example", f"mail.{plain}.net", f"{plain}.co.uk", f"{plain}.de", f"{plain}.invalid"))

    def email(self) -> str:
        r, g, f = self.r, self.given().lower(), self.family().lower().replace("'", "")
        local = r.choice((f"{g}.{f}", f"{g[0]}{f}", f"{g}_{r.randint(1, 99):02}", f"{f}+{r.choice(_EN)}", f"{g}{f}", f"{g}-{f}", g))
        local, host = (local.upper() if r.random() < 0.06 else local), self.host()
        k = r.random()
        if k < 0.6:
            return f"{local}@{host}"
        at, dot = r.choice((("[at]", "[dot]"), ("(at)", "(dot)"), ("at", "dot")))
        return f"{local} {at} " + (host if at != "at" and k < 0.75 else f" {dot} ".join(host.split(".")))

    def phone(self) -> str:
        d, r = self.digits, self.r
        area = str(r.randint(200, 989))
        return r.choice(
            (
                f"+1 {area}-{d(3)}-{d(4)}", f"({area}) {d(3)}-{d(4)}", f"{area}.{d(3)}.{d(4)}", f"{area}-{d(3)}-{d(4)}", f"1{area}{d(7)}", f"+49 {r.choice(('30', '89', '40', '221'))} {d(5)} {d(3)}", f"0{r.randint(20, 99)}/{d(r.randint(6, 8))}",
                f"+44 7{d(3)} {d(6)}", f"07{d(3)} {d(6)}", f"07{d(3)} {d(3)} {d(3)}", f"010-{d(4)}-{d(4)}", f"+82 10 {d(4)} {d(4)}", f"+33 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{r.choice(('555', d(3)))}-{d(4)}", f"+34 {d(3)} {d(3)} {d(3)}", f"0{d(3)} {d(6)}",
            )
        )

    def identity(self) -> tuple[str, str]:
        r, d = self.r, self.digits
        upper = lambda n: "".join(r.choice("ABCDEFGHKLMNPQRSTXZ") for _ in range(n))
        kind = r.choice(("ssn", "ssn", "rrn", "rrn", "passport", "licence"))
        if kind == "ssn":
            number = f"{d(3)}-{d(2)}-{d(4)}" if r.random() < 0.75 else r.choice((d(9), f"{d(3)} {d(2)} {d(4)}", f"{d(3)} {d(6)}"))
            labels = ("SSN", "SSN:", "social security number", "social security no.", "soc. sec. no.", "ssn", "Social Security Number:")
        elif kind == "rrn":
            number, labels = f"{d(6)}-{d(7)}", ("RRN", "RRN:", "주민번호", "주민등록번호", "resident number", "resident registration number")
        elif kind == "passport":
            number, labels = r.choice((upper(1) + d(8), upper(1) + d(8), upper(2) + d(7))), ("passport", "passport no.", "passport number", "Passport:", "Reisepass", "Pass-Nr.", "여권번호", "pasaporte")
        else:
            number, labels = r.choice((f"{upper(2)}{d(3)} {d(5)}", upper(1) + d(8))), ("driving licence", "licence number", "driver's license", "license no.", "Führerschein", "운전면허", "licence")
        plain = number[3:4] == "-" or number[6:7] == "-"
        return ("" if plain and r.random() < 0.2 else r.choice(labels) + " "), number

    def town(self) -> str:
        r = self.r
        return (r.choice(("New ", "Port ", "Bad ", "Upper ", "North ", "Nether ")) if r.random() < 0.25 else "") + self.syllables(2).capitalize() + (r.choice((" Falls", " Green", " Hollow", " Bay")) if r.random() < 0.2 else "")

    def address(self) -> str:
        r, d = self.r, self.digits
        up = lambda: r.choice("ABCDEHLMNPQSTWXZ")
        name = self.syllables(r.choice((1, 2, 2, 3))).capitalize()
        name = r.choice(("", "", "", "Old ", "St. ", "High ")) + name + r.choice(("", "", "", "'s"))
        k = r.random()
        if k < 0.33:
            post = f"{up()}{r.choice((up(), ''))}{r.randint(1, 19)} {r.randint(1, 9)}{up()}{up()}" if r.random() < 0.85 else ""
            town = f", {self.town()}" if r.random() < 0.85 else ""
            return f"{r.randint(1, 240)}{r.choice(('', '', '', 'a', 'b'))} {name} {r.choice(_ROADS)}" + town + (f"{r.choice((', ', ', ', ' '))}{post}" if town and post else "")
        if k < 0.6:
            flat = f", {r.choice(('Apt', 'Suite', 'Unit', 'Flat'))} {r.randint(1, 60)}" if r.random() < 0.6 else ""
            side = r.choice(("", "W. ", "E. ", "N. ", "S. "))
            return f"{r.randint(10, 9000)} {side}{name} {r.choice(_US_ROADS)}{flat}, {self.town()}, {up()}{up()} {d(5)}"
        if k < 0.8:
            street = r.choice((self.syllables(2).capitalize() + r.choice(_DE_ROADS), r.choice(("Am ", "An der ", "Zum ", "Im ")) + self.syllables(2).capitalize()))
            place = r.choice(("", "", "Bad ", "Neu ", "Alt ")) + self.syllables(2).capitalize()
            return f"{street} {r.randint(1, 180)}{r.choice(('', '', 'a', 'c'))}, {d(5)} {place}"
        if k < 0.86:
            return f"{r.randint(1, 180)} {r.choice(('Rue', 'rue', 'Avenue', 'Boulevard', 'Place'))} {r.choice(('de ', 'du ', 'des ', ''))}{self.syllables(2).capitalize()}, {d(5)} {self.syllables(2).capitalize()}"
        h = lambda n: "".join(r.choice(_KO_GIVEN) for _ in range(n))
        return f"{h(r.choice((2, 3, 4)))}{r.choice(('시', '시', '도', '군'))} {h(r.choice((2, 3)))}{r.choice(('로', '로', '길'))} {r.choice((f'{r.randint(1, 60)}길 ', ''))}{r.randint(1, 120)}"

    # --- texts

    def add(self, text: str, kind: str | None = None) -> None:
        if kind:
            self.gold.add((len(self.text), len(self.text) + len(text), kind))
        self.text += text

    def one(self, kind: str) -> None:
        if kind == "identity":
            label, number = self.identity()
            self.add(label)
            self.add(number, kind)
        else:
            self.add(getattr(self, kind)(), kind)

    def cue(self, kind: str) -> str:
        """What may stand right before a mention."""
        r = self.r
        if kind == "person":
            k = r.random()
            if k > 0.94:
                return r.choice(("Yesterday ", "Today ", "Then ", "Later ", "Gestern ", "Heute ", "Ayer ", "When ", "Since ", "Once ", "As ", "Sincerely, ", "Regards, ", "Signed, ", "Best, "))
            if k > 0.8:
                return f"{self.nouns() if r.random() < 0.6 else r.choice(_SAID).capitalize()} {r.choice('an von von für mit bei de con para by by from to for with reviewer c/o'.split())} "
            return r.choice(_LABELS) + r.choice((": ", "=", " = ", " ")) if k < 0.15 else r.choice(_TITLES) + " " if k < 0.22 else (w.capitalize() if r.random() < 0.3 else w) + r.choice((" ", " ", " ", ", ", ": ")) if (w := r.choice(_BEFORE)) and k < 0.8 else r.choice(("(", "- ", "| ", "; ", "- [ ] ", ", ", "* "))
        if kind == "email":
            return r.choice(("write to ", "mail ", "email: ", "<", "mailto:", "at ", "or ", "(", "contact ", "| ", "to ", "with ", "from ", "user=", "user_email: ", "Mail an ", "correo ", "; ", ", ", "cc ", "login "))
        if kind == "phone":
            return r.choice(("call ", "tel: ", "tel:", "tel=", "phone ", "Phone: ", "at ", "on ", "is ", "or ", "mobile ", "unter ", "Tel. ", "number is ", "al ", "전화 ", "연락처는 ", "fax ", "reach me at ", "back on ", "| ", ", "))
        if kind == "address":
            return r.choice(("at ", "to ", "from ", "near ", "lives at ", "address: ", "Address: ", "moved to ", "Anschrift ", "wohnt ", "주소: ", "주소 ", ", ", "is ", "now at ", "formerly "))
        return r.choice(("is ", "was ", "id=", "shows ", "has ", "with ", "Their ", "her ", ": ", "", "the ", ", ", "and "))

    def after(self, kind: str) -> str:
        r, k = self.r, self.r.random()
        if k < 0.25:
            return r.choice((". ", ".", ".\n", "\n", "; ", " | ", ") ", "! ", "> "))
        if kind == "person" and k < 0.6:
            return r.choice((" " + r.choice(_SAID) + " ", "'s ", ", ", " and ", " (", " about ", " on ", " at "))
        if k < 0.68:
            return " " + self.words(1, 3).capitalize() + " "
        if k < 0.85:
            return " " + self.word() + " "
        return r.choice((", ", " and ", " or ", " is ", " | ", "; ", " (", " to ", " at ", " next to "))

    def mentions(self) -> None:
        r = self.r
        for _ in range(r.choice((1, 1, 1, 2, 2, 3))):
            kind = r.choice(("person", "person", "person", "email", "phone", "phone", "identity", "address", "address"))
            if r.random() < 0.3:
                self.add(self.dressed(1, 6) + " ")
            if self.text.endswith((", ", "| ", "(", "; ")) and r.random() < 0.6:
                pass
            elif r.random() < 0.85 and not (kind == "person" and r.random() < 0.35):
                cue = self.cue(kind)
                self.add(cue if r.random() < 0.8 else cue.capitalize())
            elif self.text and not self.text.endswith((" ", "\n", "(", "|")):
                self.add(" ")
            self.one(kind)
            if kind == "phone" and r.random() < 0.1 or kind == "address" and r.random() < 0.05:
                self.add(r.choice(("로 ", "에서 ", "으로 ")))
            self.add(self.after(kind))

    def korean_mentions(self) -> None:
        r = self.r
        self.add(" ".join(r.choice(_KO_WORDS) for _ in range(r.randint(0, 4))) + " ")
        if r.random() < 0.4:
            self.add(r.choice(("담당자 ", "받는 사람 ", "성명 ", "이름: ")))
            self.add(self.korean(), "person")
            self.add(r.choice(("", " 님 ", " 씨 ", ", ", ". ")))
        else:
            self.add(self.korean(), "person")
            self.add(r.choice((" 님 ", "님 ", " 씨가 ", " 씨 ", "씨는 ", " 담당자가 ", " 귀하 ", " 님께 ")))
        if r.random() < 0.5:
            kind = r.choice(("phone", "address", "identity", "email"))
            self.add(self.cue(kind) if r.random() < 0.5 else r.choice(_KO_WORDS) + " ")
            self.one(kind)
            self.add(r.choice(("로 ", " 에서 ", " 입니다. ", ". ", " ")))

    def alike(self) -> str:
        """Something that resembles a mention and is none."""
        r, d = self.r, self.digits
        a, b, c, n = self.syllables(2).capitalize(), self.word(), self.word(), r.randint(1, 60)
        title = lambda w: w[:1].upper() + w[1:]
        groups = (
            (  # streets, places, titles and names of things
                f"{title(b)} {n}, {title(c)} {r.choice(_ROADS)}", f"{r.choice(_ROADS)} {b}", f"{a} {r.choice(_ROADS)} and {self.nouns()} {r.choice(('Falls', 'Bay', 'Hollow', 'Hall'))}", f"{title(b)}s {n}, {title(c)} {r.choice(_ROADS)} to {a} {r.choice(_ROADS)}", f"St. {a} {r.choice(('Hall', 'School', 'Church'))}",
                f"{r.choice(_TITLES)} {a}", f"{r.choice(_TITLES)} {r.choice(_FAMILY)} and {r.choice(_TITLES)} {a}", f"{r.choice(_TITLES)} {self.initial()} and {b}", f"{r.choice(('Doctor', 'Mister', 'Miss', 'Port', 'Lake', 'Mount'))} {title(b)}", f"the {a} {title(b)} {c}", f"{title(b)} {title(c)}", f"{title(b)} {n} {title(c)}",
                f"{self.nouns()} {title(b)} {r.choice(('GmbH', 'Inc', 'Ltd'))}", f"{r.choice(('Q', 'S', 'R', 'E'))}. {title(b)} {c}",
            ),
            (  # numbers
                f"order {d(4)}-{d(2)}-{d(5)}", f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(3)}-{d(5)}", f"build 20{d(6)}-{d(7)}", f"{d(8)}T{d(4)} {b}", f"20{d(2)}-{d(2)}-{d(2)}T{d(2)}:{d(2)}:00Z {b}={d(3)}", f"v{d(1)}.{d(2)}.{d(1)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(7)} {b}", f"{d(5)} {b}",
                f"192.168.{d(2)}.{d(2)}:8080", f"{d(2)}c{d(4)}e{d(2)}", f"{r.choice('abcdef')}{d(8)}", f"#{r.choice('abcdef')}{d(8)}", f"[[{r.choice('abcdef')}{d(8)}]]", f"ref {r.choice('abcdef')}{d(9)}", f"commit {r.choice('abcdef')}{d(8)} {b}", f"invoice {d(9)}", f"batch {d(10)}", f"hash {d(9)}ab", f"id {d(12)}", f"{d(1)}.{d(2)}-{d(1)}.{d(2)}", f"{d(4)} and {b}", f"{d(3)} {b} {d(2)} {c}",
            ),
            (  # senders, remotes, accounts, versions
                f"{r.choice(('noreply', 'no-reply', 'alerts', 'postmaster', 'mailer-daemon', 'notifications', 'do-not-reply', 'bot'))}@{r.choice((self.host(), 'bot.' + self.host()))}", f"git@{self.host()}:{b}/{c}.git", f"{r.choice(('user', 'root', 'admin', 'me'))}@localhost", f"{b}@{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"@{b} {c}", f"{b}@{c}:~$", f"meet at {b} dot",
            ),
            (  # lists
                f"{b}.py, {c}.md", f"{b}, {c}, {self.word()}, etc.", f"{a}, {title(b)}", f"{title(b)}, {a} {c}", f"{r.choice(_RARE)}, {r.choice(_RARE)}", f"{self.nouns()}, {self.nouns()}, {self.nouns()} usw. {r.choice(_DE)}", f"{self.nouns()}, {self.nouns()}, {self.nouns()} {r.choice(('usw.', 'etc.', 'und', 'and', 'y', 'oder'))} {b}", f"{self.nouns()}, {self.nouns()} {r.choice(('und', 'and', 'or', 'oder', 'y'))} {self.nouns()}",
            ),
            (  # seldom words side by side
                f"{self.syllables(3)} {self.syllables(2)}", f"{r.choice(_RARE)} {r.choice(_RARE)}", f"a {r.choice(_RARE)} {self.syllables(3)} {b}", f"{title(r.choice(_RARE))} {title(r.choice(_RARE))}", f"{r.choice(_RARE)} {self.syllables(2)}{r.choice(('ed', 'ing', 's', 'es'))}", f"{b} {r.choice(_RARE)} {self.syllables(2)}{r.choice(('ed', 'ing', 's', 'es'))} {c}",
                f"{b} {self.syllables(2).upper()} {title(c)}", f"{self.syllables(2).upper()} {self.syllables(3).upper()}", f"{self.syllables(2).upper()}-{d(4)}",
            ),
            (  # capitals at the start of a sentence and of nouns
                f"{r.choice(_HEADS)} {self.nouns()} {r.choice(_DE)}", f"{r.choice(_HEADS)} {self.nouns()} {r.choice(_DE)} {r.choice(_DE)} {self.nouns()}", f"{title(r.choice(_DE))} {r.choice(('der', 'den', 'von', 'la', 'de'))} {self.nouns()}", f"{r.choice(_HEADS)} {r.choice(('der', 'la', 'del', 'the'))} {self.nouns()}", f"{self.nouns()} {n} {r.choice(_DE)}",
                f"{' '.join(r.choice(_KO_WORDS) for _ in range(3))}", f"{self.korean()} {r.choice(_KO_WORDS)}을 옮겼다", f"{title(r.choice(_DE))} {self.nouns()} {r.choice(_DE)} {self.nouns()}, {self.nouns()}",
            ),
        )
        return r.choice(r.choice((*groups, groups[3])))


def labelled_sentences(n: int, seed: int = 11) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """``n`` texts of a few sentences each, with the ``(start, end, kind)`` of every mention."""
    writer, out = _Writer(seed), []
    for _ in range(n):
        writer.text, writer.gold = "", set()
        r = writer.r
        for _ in range(r.choice((1, 2, 2, 3))):
            if writer.text and not writer.text.endswith((" ", "\n")):
                writer.add(r.choice((" ", " ", "\n", ". ", " | ")))
            kind = r.random()
            if kind < 0.2:
                writer.add(writer.dressed(3, 14) + r.choice((".", ".", "!", "?", "")))
            elif kind < 0.45:
                writer.add((writer.dressed(1, 6) + " " if r.random() < 0.7 else "") + writer.alike() + r.choice((" " + writer.words(1, 6) + ".", ".", ", " + writer.words(1, 4), "")))
            elif kind < 0.51:
                writer.korean_mentions()
            else:
                writer.mentions()
        text = writer.text.rstrip() if r.random() < 0.5 else writer.text
        out.append((text, {g for g in writer.gold if g[1] <= len(text)}))
    return out

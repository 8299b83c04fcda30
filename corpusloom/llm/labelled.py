"""The small labelled table behind the personal-data tagger of problem 10.

Each line is a sentence with slots; the slots carry the labels. {P} a name after its title (the title is no part of it),
{N} a bare name, {E} e-mail, {T} phone, {A} address, {I} a labelled identity number (its label is no part of it).
Unlabelled slots: {C} company, {V} place, {D} date, {M} month, {Y} year, {K} number, {R} reference number.
Fillers are drawn from a seed, so the table is the same every time.
"""

from __future__ import annotations

import random
import re

SENTENCES = """
Contact: {P}, {T}
Contact person: {P}, tel. {T}
Contact: {N} ({E})
Press contact: {N}, phone {T}, e-mail {E}.
For enquiries about this release please reach {N} on {T} or at {E}.
For further information call {P} on {T}.
Questions may be sent to {P} at {E}, or by phone to {T}.
{P} of {A} holds {K} units ({I}).
{N} of {A} holds {K} units ({I}).
{P} of {A}, holds {K} shares.
The complaint filed by {N} ({E}) was closed on {D}.
The complaint filed by {P} was closed on {D}.
A petition from {N} ({T}) was heard on {D}.
{P} joined the board in {M} and may be called on {T}.
{N} joined the board in {M} and may be called on {T}.
{P} left the board in {M}.
Send proxy forms to {E} not later than {D}.
Forms go to {E} before {D}.
Write to {E} or call {T}.
{N} wrote: "please move my account to {A} and use {E}".
{P} wrote: "please send it to {A}".
Signed on behalf of the board by {P}, {D}.
Signed on behalf of the board by {N}, {D}.
Signed: {P}
By order of the board, {P}, secretary.
Refunds for {P} go to {E}; call back on {T}.
Refunds for {N} go to {E}; call back on {T}.
Attendance was taken by {P} and {P} at the meeting in {V}.
Attendance was taken by {N} and {P} at the meeting in {V}.
The minutes were read by {P} and {P} in {V}.
Certificates should be posted to {A}, for the attention of {N}.
Certificates should be posted to {A}, for the attention of {P}.
Parcels go to {A}.
Our registrar spoke to {N}, whose {I}, about a lost warrant for {K} units.
Our registrar spoke to {P}, whose {I}, about a lost warrant for {K} units.
Identity verified: {I}, telephone {T}.
Identity verified: {I}.
Identity verified for {N}: {I}, telephone {T}.
Witness: {N}; address: {A}; {I}.
Witness: {P}; address: {A}; {I}.
Holder {K}: {N}, {A}.
{K}: {N}, {A}.
{K}: {P}, {A}.
SMS the code to {T} to accept the offer.
Text {T} to take part.
Call {T} for a copy, or e-mail {E}.
The account of {N} was moved to {A}.
Line {K} of the {V} plant, Block {K} of the lease and Plot ratios of 4.4% were reviewed.
Block {K} of the lease in {V} and Flat rates of 12.5% were reviewed.
The {Y} base of {R} shares was split {K} for {K}.
The base of {R} shares stayed as it was.
Notes were priced @ 17.0% and settle on {D} under reference {R}.
Bonds priced @ 9.25% were placed under reference {R}.
The Kestrel Road branch and the Lantana Close depot in {V} were refitted in {M}.
The Station Street office and the Market Lane store in {V} were closed in {M}.
Invoice {R} for NGN102.4 million was cancelled.
Invoice {R} was paid on {D}.
A total of {R} units changed hands in {K} deals, according to filing FRC/{Y}/ICX/{R}.
Security code NG{R}; reference {R}; RC {K}.
Follow @newsroom or visit https://ir.company.example/{Y}/{K} for slides.
Visit www.company.example or follow @investors today.
{C} is licensed and regulated in its home market. RC {K}.
This announcement is issued by {C} and is not an offer to sell or buy any security.
Forward-looking statements in this {C} document involve risks and may differ from actual outcomes.
© {Y} {C}. All rights reserved.
{C} - building tomorrow, responsibly
Corporate Governance / {C}
Annual Report and Accounts {Y} - {C}
Interim Report {Y}   {C}
Filed by the LEDGERBANK disclosure desk on 2021-01-24 at 13:03
You are reading page {K} of the MARKETS archive - last refreshed 2023-10-05
Subscribe to MARKETS premium for NGN 187 a month
Follow MARKETS for real-time notices: {K} readers already do
Cookies help MARKETS improve this site. Accept | Decline
To unsubscribe from MARKETS alerts, manage your preferences online.
Download the {C} investor app and never miss a result
{C}: Notes on Total Assets, Third Quarter {Y}
Review of finance costs in {V}
What changed in {V} operations
In the {V} region, the audit committee reviewed revenue on {K} occasions.
At our {V} plant, sales volumes grew by 24.4% to NGN198.7 billion, driven by delayed approvals for the {V} terminal.
Within the {V} business, loans fell from NGN13.13 billion to NGN159.1 billion in {M} {Y}.
By the close of {M}, revenue reached a record NGN195.6 billion. Outside the home market, mainly in {V}, costs rose.
For Q1 {Y}, a loss of NGN37.40 billion was booked. Compared with the prior year, deposits grew.
Supply chain delays at the {V} port and growers in {V} played a part. Across our core markets, turnover rose.
For the second quarter of {Y}, the split between the {K} segments is shown above. Despite a difficult year, income grew.
The directors of {C} met in {V} on {D}. Profit Before Tax and Cost of Sales are shown in Note {K}.
Speaking to holders in {V}, the chairman said {C} would pay a dividend on {D}.
The National Identity Number, the Bank Verification Number and the Tax Number are kept in the register.
We thank the {V} community and the staff of {C} for their patience.
Dear Shareholders, the Annual General Meeting will be held in {V} on {D}.
Chairman's Statement and Chief Executive's Review follow the Directors' Report.
The Chief Executive and the Company Secretary signed the accounts. Mr Chairman thanked the Audit Committee.
Under the agreement between {C} and {C}, {K} sites moved to {V}.
A meeting of {C} with the Central Bank took place in {V} in {M} {Y}.
For {V} side, di cost of diesel don climb by 12.0% because of Naira matter.
Di company for {V} don open new branch; Oga Chairman talk say profit go rise.
Our people for {V} and {V} dey work well well. We thank God.
Pour le deuxième trimestre, le chiffre d'affaires de {C} a progressé de 12 %. Selon la Direction Générale, {V} reste stable.
Au siège de {V}, le Conseil d'Administration a approuvé les comptes. La Société {C} remercie ses clients.
By the close of {M} the Group Head Office, the Audit Committee and the Finance Department moved to {V}.
IMPORTED MALT, WHILE HOPS, SUGAR AND BARLEY ROSE, REPLACED 7.6% OF LOCALLY GROWN GRAIN IN {V}.
{V} OPERATIONS AND TOTAL ASSETS: POSITION AT {K} AUGUST
Annual Report & Financial Statements {Y}
{K} - Annual Report & Financial Statements {Y}
Chairman's Statement continued / {C}
Results Booklet {Y} - {C} - Page {K}
Against this backdrop, In Real Terms and At Group Level are set as headings by {C}.
Wheat landed at {V} cost NGN57.30 thousand per tonne, the dearest cargo on file, and {C} paid it.
Notices: Please Note. Read Also: More Updates From {C}. Unclaimed Dividend No. {K}.
Tables {R} and {R} list the units. Phase {K} of the {V} line starts in {M}.
""".strip().split("\n")  # fmt: skip

# Titles, kinds of street and the labels of identity numbers.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Dr (Mrs)", "Prof.", "Prof", "Engr.", "Engr", "Barr.", "Chief", "Alhaji", "Alhaja", "Hajia", "Rev.", "Pastor", "Sir", "Otunba", "Arc.", "Mr.", "Mrs.", "Dr.", "Mme", "M.")
STREETS = ("Street", "St.", "St", "Road", "Rd.", "Rd", "Avenue", "Ave", "Ave.", "Close", "Crescent", "Cres.", "Way", "Lane", "Drive", "Boulevard", "Court", "Estate", "Terrace")
ID_LABELS = ("NIN", "NIN no.", "N.I.N.", "NIN:", "National Identity Number", "BVN", "BVN:", "BVN no.", "Bank Verification Number", "TIN", "personal TIN", "passport", "Passport", "passport no.", "international passport", "voter card", "voter's card", "driver's licence", "driver's license", "licence no.")
CITIES = ("Lagos", "Abuja", "Kano", "Ibadan", "Enugu", "Kaduna", "Accra", "Port Harcourt", "Benin City", "Jos", "Ilorin", "Calabar")
DISTRICTS = ("Ikoyi", "Yaba", "Garki", "Wuse", "Trans-Amadi", "Surulere", "Bodija", "Apapa", "Lekki", "Old Town")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
KINDS = ("email", "phone", "id_number", "address", "person")


def examples(copies: int = 22, seed: int = 5) -> list[list[tuple[str, str | None]]]:
    """The parts (text, kind or None) of each training sentence."""
    rnd = random.Random(seed)
    pick = rnd.choice
    syll = ["ba", "mi", "to", "ren", "ka", "lu", "sho", "vi", "dor", "ne", "fa", "gri", "pel", "un", "ast", "ori", "zeb", "qua", "hen", "wy"]
    word = lambda lo=2, hi=4: "".join(pick(syll) for _ in range(rnd.randint(lo, hi))).capitalize()
    digits = lambda n: "".join(pick("0123456789") for _ in range(n))

    def name() -> str:
        first, last = word(), word()
        if rnd.random() < 0.2:
            last += "-" + word()
        form = rnd.random()
        if form < 0.16:
            return f"{last.upper()}, {first}"
        if form < 0.24:
            return f"{first[0]}. {last}"
        if form < 0.31:
            return f"{first} {word()[0]}. {last}"
        if form < 0.41:
            return f"{first} {last}".upper()
        if form < 0.46:
            return f"{first} {word()} {last}"
        if form < 0.50:
            return f"{first[0]}.{word()[0]}. {last}"
        return f"{first} {last}"

    def email() -> str:
        a, b = word().lower(), word().lower()
        local = pick([f"{a}.{b}", f"{a}{digits(2)}", f"{a}_{b[:2]}", f"{a[0]}{b}", f"{a}.{b}+news"])
        host, top = word(1, 2).lower(), pick(["test", "example", "invalid", "com", "com.ng", "org"])
        at, dot = pick([("@", "."), ("@", "."), (" @ ", "."), (" (at) ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot ")])
        out = f"{local}{at}{host}{top.replace('.', dot).join([dot, ''])}"
        return out.upper() if at == "@" and rnd.random() < 0.15 else out

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+234 {a} {b} {c}", f"+234{a}{b}{c}", f"0{a} {b} {c}", f"0{a}-{b}-{c}", f"0{a}{b}{c}", f"(0{a}) {b}-{c}", f"+234 (0) {a} {b} {c}", f"00234 {a} {b}{c}", f"234.{a}.{b}.{c}", f"+44 20 {digits(4)} {c}", f"020 {digits(4)} {c}", f"+1 (202) 555-{c}"])

    def address() -> str:
        n = f"{rnd.randint(1, 150)}{pick(['', '', '', 'A', 'B'])}"
        street = f"{word()}{pick(['', '', ' ' + word(), '-' + word()])} {pick(STREETS)}"
        head = pick([f"{n} {street}", f"{n} {street}", f"Plot {n} {street}", f"Plot {n}, {street}", f"Flat {rnd.randint(1, 9)}, {n} {street}", f"Block {pick('ABC')}{rnd.randint(1, 20)}, {n} {street}", f"No. {n} {street}", f"{n}, {street}", f"House {n}, {street}"])
        return head + pick(["", "", f", {pick(DISTRICTS)}"]) + f", {pick(CITIES)}"

    def identity() -> tuple[str, str]:
        d = digits(11)
        value = pick([d, d, f"{d[:4]}-{d[4:8]}-{d[8:]}", f"{d[:3]} {d[3:7]} {d[7:]}", f"{digits(8)}-{digits(4)}", f"{pick('AB')}{digits(8)}", f"{word(2, 3)[:3].upper()}{digits(5)}AA{digits(2)}", f"{digits(2)}F{digits(4)}B{digits(11)}"])
        return pick(ID_LABELS) + " ", value

    def reference() -> str:
        d = digits(11)
        return pick([d, digits(10), f"{d[:4]}-{d[4:8]}-{d[8:]}", "0" + digits(10)])

    plain = {
        "C": lambda: f"{word()} {pick(['Bank', 'Cement', 'Foods', 'Sugar Refinery', 'Merchant Bank', 'Telecoms', 'Energy', 'Insurance'])} {pick(['Plc', 'Plc', 'PLC', 'Nigeria Plc', 'Ltd'])}",
        "V": lambda: pick([word(), word(), f"Port {word()}", f"Lower {word()}", f"Upper {word()}", f"Saint-{word()}", f"São {word()}", f"Côte d'{word()}"]),
        "D": lambda: f"{rnd.randint(1, 28)} {pick(MONTHS)} {rnd.randint(2019, 2026)}",
        "M": lambda: pick(MONTHS),
        "Y": lambda: str(rnd.randint(2019, 2026)),
        "K": lambda: f"{rnd.randint(1, 60)},{digits(3)}" if rnd.random() < 0.5 else str(rnd.randint(1, 60)),
        "R": reference,
    }
    out = []
    for sentence in SENTENCES:
        for _ in range(copies):
            parts: list[tuple[str, str | None]] = []
            rest = sentence
            while "{" in rest:
                before, _, rest = rest.partition("{")
                slot, _, rest = rest.partition("}")
                parts.append((before, None))
                if slot == "P":
                    parts += [(pick(TITLES) + " ", None), (name(), "person")]
                elif slot == "N":
                    parts.append((name(), "person"))
                elif slot == "E":
                    parts.append((email(), "email"))
                elif slot == "T":
                    parts.append((phone(), "phone"))
                elif slot == "A":
                    parts.append((address(), "address"))
                elif slot == "I":
                    label, value = identity()
                    if before.endswith("whose "):
                        label += "is "
                    parts += [(label, None), (value, "id_number")]
                else:
                    parts.append((plain[slot](), None))
            parts.append((rest, None))
            if not any(k for _, k in parts):
                change = rnd.random()
                parts = [(t.upper() if change < 0.2 else t.lower() if change < 0.25 else t.replace(" ", "  ") if change < 0.32 else t, k) for t, k in parts]
            if rnd.random() < 0.25:  # as in wrapped texts
                parts = [(t.replace(" ", "\n", 1) if k is None and rnd.random() < 0.3 else t, k) for t, k in parts]
            out.append([p for p in parts if p[0]])
    return out


def vocabulary() -> set[str]:
    """The words the tagger knows by themselves: those of the sentences, titles, labels, streets and months; never a filler."""
    words = set()
    for s in [*(re.sub(r"\{.\}", " ", x) for x in SENTENCES), *TITLES, *STREETS, *ID_LABELS, *MONTHS, "Plc Ltd Nigeria Bank Cement Foods Sugar Refinery Merchant Telecoms Energy Insurance Port Lower Upper Saint São Côte Flat Block Plot House No is"]:
        words |= {w.lower() for w in re.findall(r"[^\W\d_]+", s)}
    return words

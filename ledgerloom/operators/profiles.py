"""Statement layouts as data: what a line means under each issuer's print format.

A profile says how to recognise section headers, section ends, page furniture,
record starts, amounts and references, and which rule gives the sign and the year.
The parsing job in `statements` is one plan for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

MON = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
MONTH_NAME = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
AMOUNT = r"^(-?\d{1,3}(?:,\d{3})*\.\d{2})$"


@dataclass(frozen=True)
class Profile:
    name: str
    layout: str  # forward | backward | fixed
    sections: tuple[tuple[str, str], ...] = ()
    end: str | None = None
    noise: str | None = None
    start: str | None = None
    amount: str = AMOUNT
    ref: str | None = None
    single: str | None = None  # one-line record
    single_fields: tuple[str, ...] = ()
    needs_section: bool = True
    tail: bool = False  # description may follow the amount
    ref_ends: bool = False  # a bare reference line ends the record
    lookback: int | None = None
    sign: str = "printed"  # printed | inverted | section | balance
    straddle: str = "end"  # which side of the period decides the year
    year_max: int = 2030
    checks: tuple[str, str] | None = None  # (section, check-number line)
    check_before_date: bool = False



# Header texts, furniture and record shapes of the supported formats.
PROFILES: tuple[Profile, ...] = (
    Profile(
        name="bank_sectioned",
        layout="forward",
        sections=(
            ("debits", r"^(?!.*Date)(?!.*Total).*Withdrawals and other debits"),
            ("credits", r"^(?!.*Date)(?!.*Total).*Deposits and other credits"),
            ("checks", r"^Checks\s*(-\s*continued)?\s*$"),
            ("fees", r"^(?!.*Total)(?!.*(?i:waived)).*Service fees"),
        ),
        end=r"continued on the next page|Total withdrawals and other debits|Total deposits and other credits|Total checks|Total # of checks|Total service fees|Note your Ending Balance",
        noise=r"^(Date|Description|Amount|Check #|Transaction description)$",
        start=r"^(\d{1,2}/\d{1,2}/\d{2})$",
        sign="printed",
    ),
    Profile(
        name="card_fixed",
        layout="fixed",
        sections=(
            ("purchases", r"^(?!.*TOTAL).*Purchases and Other Charges"),
            ("credits", r"^(?!.*TOTAL).*Payments and Other Credits"),
        ),
        end=r"TOTAL PURCHASES AND OTHER CHARGES FOR THIS PERIOD|TOTAL PAYMENTS AND CREDITS|TOTAL PAYMENTS AND OTHER CREDITS",
        start=r"^(\d{1,2}/\d{1,2})$",
        amount=r"^(-?\s*\d{1,3}(?:,\d{3})*\.\d{2})$",
        ref=r"^\d{15,}$",
        single=r"^(\d{1,2}/\d{1,2})\s+(\d{1,2}/\d{1,2})\s+(.+?)\s+(\d{15,})\s+(-?\s*[\d,]+\.?\d{0,2})\s*$",
        single_fields=("date", "tx_date", "description", "reference", "amount"),
        sign="inverted",
    ),
    Profile(
        name="running_balance",
        layout="forward",
        sections=(("activity", r"CHECKING ACTIVITY"),),
        end=r"Total Debits/Credits|^-- .* of ",
        noise=r"Page .* of ",
        start=r"^(\d{1,2}/\d{1,2})\s*$",
        amount=r"^([\d,]+\.\d{2}-?)\s*$",
        single=r"^(\d{1,2}/\d{1,2})\s+(.+?)\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2}-?)\s*$",
        single_fields=("date", "description", "amount", "balance"),
        tail=True,
        sign="balance",
    ),
    Profile(
        name="amount_date",
        layout="backward",
        noise=r"(?i)BALANCE LAST STATEMENT|BALANCE THIS STATEMENT|TOTAL DAYS IN STATEMENT PERIOD|ITEMIZATION OF SERVICE CHARGE|TOTAL CHARGE|Description Transaction Amount|Page:|STATEMENT DATE|ACCOUNT NUMBER|Phone:|Website:|SPLITHERE",
        amount=r"^(-?\s*[\d,]+\.\d{2})\s+\d{1,2}/\d{1,2}\s*$",
        start=r"^-?\s*[\d,]+\.\d{2}\s+(\d{1,2}/\d{1,2})\s*$",
        ref=r"^[\d,]+\.\d{2}\s*$",  # bare balance line: a break, not text
        single=r"^(.+?)\s+(-?[\d,]+\.\d{2})\s+(\d{1,2}/\d{1,2})\s+([\d,]+\.\d{2})\s*$",
        single_fields=("description", "amount", "date", "balance"),
        needs_section=False,
        sign="printed",
    ),
    Profile(
        name="month_day",
        layout="forward",
        noise=r"(?i)Reference numbers|Date Amount Activity|Total Electronic Deposits|Total Number of|Total Other Deposits|Total checks paid|Total ATM/Debit Card|Total Electronic withdrawals|this statement period|Account summary|Beginning balance|Ending balance|Page |Basic Business Checking|Account number",
        sections=(("checks", r"Checks paid this statement period"),),
        end=r"Total checks paid|Total number of checks",
        start=rf"(?i)^({MON}\s*\d{{1,2}})\s*$",
        amount=r"^(-?[\d,]+\.\d{2})\s*$",
        ref=r"^\d{7,}\s*$",
        single=rf"(?i)^({MON}\s*\d{{1,2}})\s+(-?[\d,]+\.\d{{2}})\s+(.+)$",
        single_fields=("date", "amount", "description"),
        needs_section=False,
        tail=True,
        ref_ends=True,
        checks=("checks", r"^[#@*](\d+)\s*$"),
        sign="printed",
    ),
    Profile(
        name="sectioned_checking",
        layout="forward",
        sections=(
            ("credits", r"(?i)^(customer deposits|other deposits)"),
            ("debits", r"(?i)^other withdrawals"),
            ("checks", r"(?i)^(checks presented|checks paid)"),
        ),
        end=r"(?i)^balance summary",
        noise=r"(?i)^(date|description of transaction|ref number|amount|check|\$)$",
        start=rf"(?i)^({MON}\s+\d{{1,2}})(?:\s+.*)?$",
        amount=r"^\$?\s*([\d,]+\.\d{2}\s*-?)\s*$",
        sign="section",
        year_max=2035,
        checks=("checks", r"^(\d{4,})\*?\s*$"),
        check_before_date=True,
    ),
    Profile(
        name="card_open_close",
        layout="backward",
        sections=(
            ("credits", r"(?i)payments and other credits"),
            ("purchases", r"(?i)purchases and other debits"),
            ("fees", r"(?i)total fees this period|fees.*post.*date"),
        ),
        noise=r"(?i)^(total this period|total fees this period|post|date|trans|ref #|notation|amount)$|Transaction Description",
        start=r"^(\d{1,2}/\d{1,2})\s*$",
        amount=r"^\s*\$?([\d,]+\.\d{2})(?:\s+CR)?\s*$",
        ref=r"^\d{4,}\s*$",
        lookback=15,
        sign="section",
    ),
    Profile(
        name="card_billing",
        layout="forward",
        sections=(
            ("credits", r"(?i)^.+?#\d{4}:\s*Payments, Credits and Adjustments\s*$"),
            ("purchases", r"(?i)^.+?#\d{4}:\s*Transactions\s*$"),
            ("fees", r"(?i)^fees$"),
            ("interest", r"(?i)^interest charged$"),
        ),
        end=r"(?i)interest charge calculation|^total |: total transactions$|^transactions(?: \(continued\))?$",
        noise=r"(?i)^(tk#:|orig:|dest:|psgr:|carrier:|svc:|s/o:)|^(trans date|post date|description|amount)$|visit capitalone\.com|additional information on the next page|page .* of |spark cash.*ending in|days in billing cycle",
        start=rf"^([A-Za-z]{{3}}\s+\d{{1,2}})$",
        amount=r"^\s*(-?\s*\$[\d,]+\.\d{2})\s*$",
        sign="section",
        straddle="start",
        year_max=2035,
    ),
)

BY_NAME = {p.name: p for p in PROFILES}

# Issuer words, most specific first, and the profile each one means.
ISSUER_RULES: tuple[tuple[tuple[str, ...], tuple[tuple[tuple[str, ...], str], ...]], ...] = (
    (("fremont bank", "fremont"), (((), "amount_date"),)),
    (("comerica",), (((), "month_day"),)),
    (("citibank", " citi "), (((), "running_balance"),)),
    (
        ("bank of america", "bofa"),
        (
            (("withdrawals and other debits",), "bank_sectioned"),
            (("purchases and other charges", "credit card"), "card_fixed"),
            ((), "bank_sectioned"),
        ),
    ),
    (
        ("u.s. bank", "us bank", "usbank"),
        (
            (("credit card", "purchases and other debits", "business altitude", "cardmember"), "card_open_close"),
            (("checking", "business statement", "customer deposits"), "sectioned_checking"),
            (("file:credit card", "file: cc "), "card_open_close"),
            ((), "sectioned_checking"),
        ),
    ),
    (
        ("capital one", "capitalone.com"),
        (
            (("credit card", "spark cash", "mastercard", "payments, credits and adjustments"), "card_billing"),
            (("file:credit card", "file: cc ", "file:capital one cc"), "card_billing"),
        ),
    ),
)

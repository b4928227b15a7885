"""The structured patterns, in Java's dialect. None matches the empty string. ``\\d``, ``\\s`` and ``\\w`` are ASCII."""

from __future__ import annotations

from dataclasses import dataclass

from inkveil.functions.lexicon import ANONYMISED

#: A letter, digit or underscore of any script.
WORD = "\\p{L}\\p{N}_"
_OCTET = "(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)"
_SEP = "[-.\\s]"
_STREETS = (
    "Boulevard Parkway Highway Terrace Commons Avenue Street Square Circle Drive Court Place Trail Alley Blvd Pkwy Road Lane Loop "
    "Ave Cir Ter Way Hwy Trl St Rd Dr Ln Ct Pl Sq"
)
_SIDES = "Northeast|Northwest|Southeast|Southwest|North|South|East|West|[NSEW]\\.?"


@dataclass(frozen=True)
class Pattern:
    kind: str
    regex: str
    #: Text without any of these can't match; checked before the expression runs.
    needs: tuple[str, ...] = ()


EMAIL = Pattern("EMAIL", "\\b[\\w.%+-]+@(?:[A-Za-z\\d-]+\\.)+[A-Za-z]{2,}\\b", ("@",))
URL = Pattern("URL", "\\b(?:https?://[^\\s<>\"']+|www(?:\\.[A-Za-z\\d-]+){2,}[^\\s<>\"']*)", ("://", "www."))
SSN = Pattern("US_SOCIAL_SECURITY_NUMBER", "\\b(?!000|666|9)\\d{3}[-\\s](?!00)\\d\\d[-\\s](?!0000)\\d{4}\\b")
IP = Pattern("IP_ADDRESS", f"\\b{_OCTET}(?:\\.{_OCTET}){{3}}\\b", (".",))
PHONE = Pattern(
    "PHONE",
    f"(?<![{WORD}-])(?:\\+?\\d{{1,3}}{_SEP}?)?(?:\\(\\d{{3}}\\){_SEP}*\\d{{3}}{_SEP}?|(?:\\d{{3}}{_SEP}){{2}})\\d{{4}}"
    f"(?:\\s*(?:ext(?:ension|\\.)?|x)\\s*\\d{{1,6}})?(?![{WORD}-])",
)
ADDRESS = Pattern(
    "ADDRESS",
    f"\\b\\d{{1,6}}\\s+(?:{_SIDES})?\\s*(?:[A-Z][A-Za-z.'-]*\\s+){{0,4}}(?:{'|'.join(_STREETS.split())})\\b\\.?"
    "(?:\\s*(?:Apartment|Suite|Unit|Apt|Ste|#)\\s*[\\w-]+)?",
)
DOB = Pattern("DATE_OF_BIRTH", "(?i)\\b(?:born\\s+on|date\\s+of\\s+birth|d\\.?o\\.?b\\.?)\\s*:?\\s*(?:\\d{1,2}[/-]){2}\\d{2,4}\\b")
USERNAME = Pattern("USERNAME", f"(?<![{WORD}@.])@(?!(?:{'|'.join(sorted(ANONYMISED))})\\d*\\b)\\w{{3,30}}\\b", ("@",))
CARD = Pattern("CREDIT_DEBIT_CARD_NUMBER", "\\b(?:\\d[ -]?){12,18}\\d\\b")
ZIP = Pattern("ZIP_CODE", "\\b\\d{5}(?:-\\d{4})?\\b(?=\\s*$|\\s*[.,]|\\s+[A-Z]{2}\\b)")
AGE = Pattern("AGE", "(?i)\\b(?:(?:I\\s+am|I'm|aged?(?:\\s+of)?)\\s+\\d{1,2}\\b|\\d{1,2}\\s+years?\\s+old\\b)")

BEFORE_IDENTITY = (EMAIL, URL)
AFTER_IDENTITY = (SSN, IP, PHONE, ADDRESS, DOB, USERNAME)
ALL = (*BEFORE_IDENTITY, *AFTER_IDENTITY, CARD, ZIP, AGE)

#: The looser set of the simulated service, unnumbered, in its order.
STUB = (
    Pattern("EMAIL", "[\\w.+-]+@[\\w-]+\\.[\\w.-]+", ("@",)),
    Pattern("US_SOCIAL_SECURITY_NUMBER", "\\b\\d{3}-\\d{2}-\\d{4}\\b"),
    Pattern("CREDIT_DEBIT_CARD_NUMBER", "\\b(?:\\d[ -]?){13,16}\\b"),
    Pattern("PHONE", f"\\b(?:\\+?1{_SEP}?)?\\(?\\d{{3}}\\)?{_SEP}?\\d{{3}}{_SEP}?\\d{{4}}\\b"),
    Pattern("IP_ADDRESS", "\\b\\d{1,3}(?:\\.\\d{1,3}){3}\\b"),
)

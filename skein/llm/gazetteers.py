"""Word lists for the labelers of personal data; ``pii.find`` takes others in their place."""

from __future__ import annotations

from dataclasses import dataclass

#: Common given names of several languages.
GIVEN = """
adam ahmed alan albert alejandro alex alexander alice alicia amelia amy ana andrea andreas andrew angela anita ann anna anne antoine antonio arthur barbara beatriz ben
benjamin bernard brian camille carla carlos carmen caroline catherine charles charlotte chloe chris christian christine claire claudia clara daniel david diana diego dieter dominique
edward elena eleanor elizabeth emily emma enrique eric erika eva felix fernando francisco frank franz friedrich gabriel george gerhard gertrud giovanni grace greta guillaume
hannah hans harry heinz helen helga henry hugo ines ingrid isabel isabelle ivan jack jacob jacques james jan jane javier jean jennifer jessica joan johann johannes john jonas jorge jose
joseph juan judith julia julie julien jürgen karen karl katharina kevin klaus kurt laura lena leo linda lisa louis lucia lucy luis luisa lukas manfred manuel marc marco margaret maria marie
mario mark markus marta martin mary matthew max michael michel miguel mohammed monika nathalie nicolas nina olivia oscar pablo patricia paul pedro peter petra philip philippe pierre
""".split()
#: Countries whose account numbers begin with two letters, with the numbers' lengths.
ACCOUNTS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18,
    "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
#: Frequent ends of host names.
TOP_DOMAINS = "com org net edu gov mil int info biz name pro io co ai app dev me tv cc us uk de fr es it nl be ch at se no dk fi pl cz sk hu ro bg gr pt ie lu ru ua tr il ae sa in cn jp kr tw hk sg my th vn id ph au nz za ng ke eg ma br ar cl mx pe ve ca eu cat example test".split()
#: One- and two-digit country codes of telephone numbers; three-digit ones begin as ``CALLING_GROUPS``.
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
CALLING_GROUPS = "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()


@dataclass(frozen=True)
class Gazetteers:
    given: frozenset[str] = frozenset(GIVEN)
    domains: frozenset[str] = frozenset(TOP_DOMAINS)
    calling: frozenset[str] = frozenset(CALLING + CALLING_GROUPS)

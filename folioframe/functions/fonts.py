"""Fonts of formulas by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of whole names (after a subset prefix) of formula fonts, asked first.
FORMULA_NAMES = """
.*Asana.*
.*MiriamMonoCLM-BookOblique.*
.*Miriam Mono CLM.*
.*Logix.*
.*AeBonum.*
.*AeMRoman.*
.*AePagella.*
.*AeSchola.*
.*Concrete.*
.*LatinModernMathCompanion.*
.*Latin Modern Math Companion.*
.*RalphSmithsFormalScriptCompanion.*
.*Ralph Smiths Formal Script Companion.*
.*TeXGyreBonumMathCompanion.*
.*TeX Gyre Bonum Companion.*
.*TeXGyrePagellaMathCompanion.*
.*TeX Gyre Pagella Math Companion.*
.*TeXGyreTermesMathCompanion.*
.*TeX Gyre Termes Math Companion.*
.*XITSMathCompanion.*
.*XITS Math Companion.*
.*Erewhon.*
.*Euler-Math.*
.*Euler Math.*
.*FiraMath-Regular.*
.*Fira Math.*
.*Garamond-Math.*
.*GFSNeohellenicMath.*
.*KpMath.*
.*Lete Sans Math.*
.*LeteSansMath.*
.*Linux Libertine O.*
.*LibertinusMath-Regular.*
.*Libertinus Math.*
.*LatinModernMath-Regular.*
.*Latin Modern Math.*
.*Luciole.*
.*NewCM.*
.*NewComputerModern.*
.*OldStandard-Math.*
.*STIXMath-Regular.*
.*STIX Math.*
.*STIXTwoMath-Regular.*
.*STIX Two Math.*
.*TeXGyreBonumMath.*
.*TeX Gyre Bonum Math.*
.*TeXGyreDejaVuMath.*
.*TeX Gyre DejaVu Math.*
.*TeXGyrePagellaMath.*
.*TeX Gyre Pagella Math.*
.*TeXGyreScholaMath.*
.*TeX Gyre Schola Math.*
.*TeXGyreTermesMath.*
.*TeX Gyre Termes Math.*
.*XCharter-Math.*
.*XCharter Math.*
.*XITSMath-Bold.*
.*XITS Math.*
.*XITSMath.*
.*IBMPlexMath.*
.*IBM Plex Math.*
"""

#: Patterns of whole names of text fonts, asked second.
TEXT_NAMES = """
BLKFort.*
Cambria.*
EUAlbertina.*
NimbusRomNo9L.*
GlosaMath.*
URWPalladioL.*
CMSS.+
Arial.*
TimesNewRoman.*
SegoeUI.*
CMTT9.*
CMSL10.*
CMTI10.*
CMTT10.*
CMTI12.*
CMR12.*
MeridienLTStd.*
Calibri.*
STIXMathJax_Main.*
.*NewBaskerville.*
.*FranklinGothic.*
.*AGaramondPro.*
.*PalatinoItalCOR.*
.*ITCSymbolStd.*
.*PlantinStd.*
.*DJ5EscrowCond.*
.*ExchangeBook.*
.*DJ5Exchange.*
.*Times.*
.*PalatinoLTStd.*
.*Times New Roman,Italic.*
.*EhrhardtMT.*
.*GillSansMTStd.*
.*MedicineSymbols3.*
.*HardingText.*
.*GraphikNaturel.*
.*HelveticaNeue.*
.*GoudyOldStyleT.*
.*Symbol.*
.*ScalaSansLF.*
.*ScalaLF.*
.*ScalaSansPro.*
.*PetersburgC.*
.*ColiseumC.*
.*Gantari.*
.*OptimaLTStd.*
.*CronosPro.*
.*ACaslon.*
.*Frutiger.*
.*BrandonGrotesque.*
.*FairfieldLH.*
.*CaeciliaLTStd.*
.*Whitney.*
.*Mercury.*
.*SabonLTStd.*
.*AnonymousPro.*
.*SabonLTPro.*
.*ArnoPro.*
.*CharisSIL.*
.*MSReference.*
.*CMUSerif-Roman.*
.*CourierNewPS.*
.*XCharter.*
.*GillSans.*
.*Perpetua.*
.*GEInspira.*
.*AGaramond.*
.*BMath.*
.*MSTT.*
.*Bookinsanity.*
.*ScalySans.*
.*Code2000.*
.*Minion.*
.*JansonTextLT.*
.*MathPack.*
.*Macmillan.*
.*NimbusSan.*
.*Mincho.*
.*Amerigo.*
.*MSGloriolaIIStd.*
.*CMU.+
.*LinLibertine.*
.*txsys.*
"""

#: Patterns of the beginnings of formula fonts' names, asked last; a caller's pattern stands in for them.
FORMULA_STARTS = """
CM[^RB]
(MS|XY|MT|BL|RM|EU|LA|RS)[A-Z]
LINE
LCIRCLE
TeX-
rsfs
txsy
txmia
wasy
stmary
.*Mono
.*Code
.*Sym
.*Math
AdvP4C4E74
AdvPSSym
AdvP4C4E59
"""


def any_of(patterns: str, end: str = "") -> str:
    """One pattern for lines of patterns."""
    return f"^({'|'.join(patterns.split(chr(10))[1:-1])}){end}"


def formula_font(name: Column, pattern: str | None = None) -> Column:
    """F-FORMULA-FONT: a precise formula font, else no text font and by `pattern` or the broad rule a formula font.

    A name may be `BASE64:` and encoded bytes. Null stays null, an empty name is no formula font.
    """
    plain = F.when(name.startswith("BASE64:"), F.decode(F.unbase64(F.substring(name, 8, 1 << 20)), "ISO-8859-1")).otherwise(name)
    font = F.element_at(F.split(plain, r"\+"), -1)
    broad = font.rlike(f"^(?:{pattern})" if pattern else any_of(FORMULA_STARTS))
    return (font != "") & (font.rlike(any_of(FORMULA_NAMES, "$")) | (~font.rlike(any_of(TEXT_NAMES, "$")) & broad))

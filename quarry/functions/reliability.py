"""When the text of a fact is believed, as a table of rules: the first row of a field that holds decides."""

from __future__ import annotations

from .phrases import Verdict

#: Name -> (pattern, whether it reads the folded text).
PATTERNS = {
    "long_date": (r"(?iu)\b\d{1,2}(?:er)?\s+(?:janvier|f[eé]vrier|mars|avril|mai|juin|juillet|ao[uû]t|septembre|octobre|novembre|d[eé]cembre)\s+\d{4}", False),
    "short_date": (r"\b(?:\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})", False),
    "number": (r"\d", False),
    "amount": (r"(?i)\b\d[\d\s.,()]*\s*(?:DT|TND|dinars?)\b", False),
    "word_amount": (r"\b(?:douze|cinq|dix|vingt) mille\b", True),
    "percent": (r"\b\d+(?:[.,]\d+)?\s*%(?=\s|$|[.;,)])", False),
    "arabic_percent": (r"(?<!\d)\d{1,2}\s+96\b", False),
    "duration": (r"\b\d+ ?(?:\([^)]*\) ?)?(?:jours?|mois|ans?|heures?)\b", True),
    "word_duration": (r"\b(?:une|un|deux|trois|quatre|cinq|six|douze) ?(?:\( ?\d+ ?\) ?|\d+ )?(?:jours?|mois|ans?|annees?)\b|\( ?\d+ ?\) ?(?:jours?|mois|ans?|annees?)\b", True),
    "offer_duration": (r"\b(?:\d+ ?(?:jours?|mois|ans?)|90|120|60|180|quatre[- ]vingt[- ]dix|trois mois|six mois)\b", True),
    "blanks": (r"\.{4,}|\( ?[67] ?\)", True),
    "long_line": (r".{141}", True),
}

#: Phrases by which the contexts of facts are told.
CONTENTS_VERBS = (" est ", " sont ", " sera ", " seront ", " doit ", " doivent ", " fixe ", " pay", " par jour", "reception quantitative", "reception provisoire", "reception definitive")
ARABIC_DEADLINE = ("آخر أجل", "اخر أجل", "أجل أقصاه", "اجل اقصاه", "التاريخ الأقصى", "التاريخ الاقصى")
ARABIC_CAUTION = ("الضمان المالي الوقتي", "الضمان الوقتي")
ARABIC_WARRANTY = ("مدة الضمان", "مدة ضمان", "أشهر", "اشهر")
ARABIC_DURATION = ("أشهر", "اشهر", "شهر", "شهور", "يوم", "سنة", "سنوات")
ARABIC_PENALTY = ("غرامة تأخير", "غرامة التأخير", "غرامات التأخير", "عقوبة التأخير", "خطايا التأخير")
ARABIC_RECEPTION = ("الاستلام", "الإستلام")
ARABIC_VALIDITY = ("صلوحية العروض", "يلتزم العارض بعرضه", "يبقى المتعهدون ملتزمون", "تسعون يوما", "ستون يوما", "120 يوما", "٩٠")
WARRANTY = (
    "delai de garantie", "duree de garantie", "periode de garantie", "garantie est fixe", "garantie est de", "garantie de", "periode de 6 mois",
    "garantie est d'une annee", "garantie est d une annee", "annee de garantie", "garantie et maintenance", "garantir la solution globale",
    "garantit gratuitement", "garantie et services apres vente",
)
WARRANTY_ENDS = ("annee de garantie", "garantie est d'une annee", "garantie est d une annee")
FORM_TEXT = (
    "cautionnement provisoire pour participer", "le montant du dit cautionnement", "m'engage", "nous engageons", "fait a", "publie(e) en date",
    "relatif-relative", "relatif relative",
)
FORM_WORDS = ("annexe", "modele", "formulaire")
CLAUSE_WORDS = (
    "doit fournir", "doit presenter", "doit etre accompagne", "doit etre etabli", "montant de la caution est egal", "remis", "est fixe", "s'eleve",
    "s eleve", "chaque offre", "dans son offre", "a l'appui de son offre",
)
DEFINITIVE = ("definit", "bonne fin", "bonne execution", "الضمان المالي النهائي", "الضمان النهائي", "ضمانا ماليا نهائيا", "ضمانا نهائيا", "ضمان مالي نهائي", "ضمان نهائي")
OFFER_PARTS = ("piece jointe", "pieces jointes", "a telecharger", "envoye en ligne", "offre financiere", "bordereau des prix", "bordereaux des prix", "non presentation du cautionnement")
RECEPTION_FALSE = (
    "composition de l'offre", "piece jointe", "pieces jointes", "a telecharger", "envoye en ligne", "annexe", "formulaire", "liste nominative",
    "offre financiere", "soumission", "bordereaux des prix", "bordereau des prix", "non presentation du cautionnement", "fiches techniques", "references",
)
RECEPTION_TRUE = (
    "reception quantitative", "reception provisoire", "reception definitive", "sera prononcee", "est prononcee", "modalites de reception",
    "reception technique", "pv de reception", "proces-verbal de reception",
)
RECEPTION_WORDS = ("provisoire", "definitive", "quantitative", "prononce", "pv", "proces-verbal", "modalites")
TENDER = (
    "soumission", "offre technique", "offre financiere", "enveloppe", "pli", "tuneps", "bureau d'ordre", "bureau d ordre", "depot des offres",
    "depot de l'offre", "remise des offres", "reception des offres", "voie postale", "rapid poste", "rapide poste", "منظومة الشراء العمومي", "تونبس",
    "ارسال العرض", "إرسال العرض", "مكتب الضبط", "البريد مضمون الوصول", "البريد السريع",
)
VALIDITY_FALSE = ("caution", "garantie", "execution", "contrat", "marche", "bancaire")
VALIDITY_TRUE = ("offre", "soumission", "valable")
VALIDITY_NAMED = ("validite de la soumission", "validite de l'offre", "validite des offres")
REFERENCES = (
    "references similaires", "reference similaire", "references pertinentes", "reference pertinente", "projets similaires", "travaux similaires",
    "references techniques", "references financieres", "memes marques", "meme marque", "attestations de bonne execution",
    "attestation de bonne execution", "certificats", "contrats", "pvs de reception", "pv de reception", "justificatifs", "مشاريع مماثلة",
    "مراجع مماثلة", "أعمال مماثلة", "اعمال مماثلة",
)
MAKER_WARRANTY = ("attestation de garantie", "garantie constructeur", "garantie du constructeur", "garantie de constructeur")
MAKER_LETTER = (
    "autorisation", "agrement", "lettre", "habilite", "partenariat", "partenaire", "service delivery partner", "canal officiel", "commercialiser",
    "represent", "originalite", "certification",
)
MAKER = ("constructeur", "fabricant", "editeur", "hpe")
MAKER_PROOF = (
    "autorisation", "attestation", "certification", "certificat", "partenariat", "originalite", "service delivery partner", "habilite", "canal officiel",
)

_MANY = 10_000


def _form(field: str) -> list[Verdict]:
    """Forms to be filled in are no clauses."""
    return [
        Verdict(field, False, any_of=(FORM_TEXT,)),
        Verdict(field, False, any_of=(FORM_WORDS,), shown=("blanks",)),
        Verdict(field, False, any_of=(FORM_WORDS,), forbid=CLAUSE_WORDS),
    ]


RELIABLE = [
    Verdict(None, False, starts=("article",), forbid=CONTENTS_VERBS, lacks=("long_line",)),
    Verdict("guarantee", False, any_of=(("الضمان المالي الوقتي", "الضمان المالي النهائي"),)),
    Verdict("guarantee", True, any_of=(ARABIC_WARRANTY,), shown=("number",)),
    Verdict("guarantee", True, any_of=(ARABIC_WARRANTY, ARABIC_DURATION)),
    Verdict("guarantee", False, any_of=(ARABIC_WARRANTY,)),
    Verdict("guarantee", True, any_of=(("expiration du delai de garantie",), WARRANTY_ENDS), forbid=("fix",)),
    Verdict("guarantee", False, any_of=(("expiration du delai de garantie",),), forbid=("fix",)),
    Verdict("guarantee", True, any_of=(WARRANTY,), shown=("duration", "word_duration")),
    Verdict("guarantee", False),
    Verdict("deadline", True, any_of=(ARABIC_DEADLINE,), shown=("number",)),
    Verdict("deadline", False, any_of=(ARABIC_DEADLINE,)),
    Verdict("deadline", True, shown=("long_date", "short_date")),
    Verdict("deadline", False),
    Verdict("caution", False, any_of=(("restitution", "mise en paiement"),)),
    Verdict("caution", True, any_of=(("cautionnement provisoire",), ("montant fixe de",), ("dinars",), ("120",))),
    *_form("caution"),
    Verdict("caution", True, any_of=(ARABIC_CAUTION,), shown=("number",)),
    Verdict("caution", True, any_of=(ARABIC_CAUTION, ("دينار", "يوما"))),
    Verdict("caution", False, any_of=(ARABIC_CAUTION,)),
    Verdict("caution", True, shown=("amount", "word_amount", "percent")),
    Verdict("caution", True, any_of=(("trois pour cent", "exige"),)),
    Verdict("caution", False),
    *_form("definitive_caution"),
    Verdict("definitive_caution", False, forbid=DEFINITIVE),
    Verdict("definitive_caution", True, shown=("amount", "word_amount", "percent", "arabic_percent")),
    Verdict("definitive_caution", True, any_of=(("بالمائة", "exige", "doit fournir", "doit constituer"),)),
    Verdict("definitive_caution", False),
    Verdict("penalties", False, starts=("resiliation",)),
    Verdict("penalties", True, any_of=(ARABIC_PENALTY,)),
    Verdict("penalties", True, any_of=(("penalite",), ("retard", "jour", "pour mille"))),
    Verdict("penalties", False),
    Verdict("reception", False, any_of=(("reception",), ("composition de l'offre",), OFFER_PARTS)),
    Verdict("reception", False, any_of=(("reception",),), counts=((RECEPTION_FALSE, 2, _MANY), (RECEPTION_TRUE, 0, 1))),
    Verdict("reception", False, any_of=(("reception",),), counts=((RECEPTION_FALSE, 4, _MANY), (RECEPTION_TRUE, 0, 3))),
    Verdict("reception", True, any_of=(ARABIC_RECEPTION,)),
    Verdict("reception", True, any_of=(("reception",), RECEPTION_WORDS)),
    Verdict("reception", False),
    Verdict("submission_method", True, any_of=(TENDER,)),
    Verdict("submission_method", False),
    Verdict("validity", True, any_of=(ARABIC_VALIDITY,)),
    Verdict("validity", False, any_of=(VALIDITY_FALSE,), forbid=VALIDITY_TRUE),
    Verdict("validity", True, any_of=(VALIDITY_NAMED,)),
    Verdict("validity", True, shown=("offer_duration",)),
    Verdict("validity", True, any_of=(("valable",),)),
    Verdict("validity", False),
    Verdict("references", True, any_of=(REFERENCES,)),
    Verdict("references", False),
    Verdict("manufacturer_authorization", False, any_of=(MAKER_WARRANTY,), forbid=MAKER_LETTER),
    Verdict("manufacturer_authorization", True, any_of=(MAKER, MAKER_PROOF)),
    Verdict("manufacturer_authorization", False),
]

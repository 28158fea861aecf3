"""Rule dictionaries as plain data. They become small dimension tables or column expressions."""

# Patterns that name a section of a tender document, in order.
SECTION_PATTERNS = {
    "admin": r"(document administratif|registre|cnss|attestation|déclaration|affiliation|matricule|légalis|وثائق إدارية|سجل تجاري|تصريح|الإدارة العامة للإعلامية)",
    "technical": r"(document technique|spécification|caractéristique|installation|configuration|matériel|équipement|وثائق فنية|مواصفات|rapport de test|fiche technique)",
    "financial": r"(document financier|bordereau|prix|offre financière|lettre de soumission|montant|عرض مالي|أثمان|أسعار|جدول الأثمان|تعهد مالي)",
    "guarantee": r"(caution|cautionnement|garantie bancaire|garantie définitive|garantie provisoire|ضمان وقتي|ضمان نهائي|كفيل بالتضامن|كفالة بنكية|الضمان الوقتي|الضمان النهائي|ضمان حسن التنفيذ|مدة الضمان)",
    "deadline": r"(date limite|délai de remise|validité|ouverture des plis|heure limite|تاريخ أقصى|آجال|فتح العروض|جلسة|قبول العروض|تقديم العروض|تونيبس|مكتب الضبط|البريد السريع|مضمون الوصول|منظومة الشراء العمومي|الساعة المحددان|اليوم المحدد)",
    "payment": r"(modalit|paiement|règlement|versement|échéance|facture|تحويل بنكي|خلاص|دفع|أقساط|فاتورة)",
    "penalty": r"(pénalité|retard|sanction|indemnité|amende|تغريم|غرامة|عقوبة|تأخير|فسخ)",
    "reception": r"(réception provisoire|réception définitive|réception quantitative|livraison|installation|استلام|تسليم|قبول)",
}
SECTION_PRIORITY = {"deadline": 8, "admin": 7, "penalty": 6, "payment": 5, "financial": 4, "guarantee": 3, "technical": 2, "reception": 1, "general": 0}

# Lengths in characters.
MIN_USEFUL_CHARS, MERGE_TARGET_CHARS, MAX_CHUNK_CHARS = 40, 180, 1200
DIRECT_TEXT_CHARS, PLAIN_ENTRY_CHARS = 12000, 4500
PASSAGE_CHARS, PASSAGE_TARGET = 1800, 1600

# Words that widen a question that contains the key.
QUERY_EXPANSIONS = {
    "caution": "caution cautionnement provisoire définitive garantie bancaire engagement solidaire ضمان وقتي الضمان الوقتي يرجع الضمان الوقتي ضمان نهائي الكفيل بالتضامن كفلائهم بالتضامن كفالة بنكية",
    "délai": "délai livraison installation période durée أجل تسليم مدة تنفيذ",
    "paiement": "paiement modalité conditions échéance versement خلاص دفع أقساط فاتورة",
    "offre": "offre soumission dépôt remise envoi plateforme تونبس تقديم العروض إيداع إرسال",
    "réception": "réception provisoire définitive livraison validation استلام تسليم قبول",
    "garantie": "garantie durée maintenance SAV après-vente ضمان مدة الضمان صيانة",
    "document": "document administratif technique registre attestation وثائق إدارية فنية",
    "cnss": "CNSS affiliation attestation solde الضمان الاجتماعي",
    "registre": "registre commerce RNE identification سجل تجاري المؤسسات",
    "variante": "variante alternative substitut option بديل عروض بديلة",
    "ouverture": "ouverture plis séance publique ouverture des offres فتح العروض جلسة علنية",
    "soumission": "soumission dépôt plateforme envoi remise تقديم العروض تونبس إيداع إرسال",
    "validité": "valable validité offre reste valable délais de validité des offres الالتزام بالعروض الالتزام ببنود وشروط هذا التعهد هذا التعهد لمدة 90 120 يوما",
    "références": "références projets installation justificatifs مراجع",
    "financier": "financier prix bordereau soumission lettre عرض مالي أثمان أسعار",
    "constructeur": "constructeur partenariat officielle lettre مصنع",
    "pénalité": "pénalité retard sanction amende تغريم غرامة عقوبة تأخير فسخ",
    "objet": "objet cahier charges acquisition fourniture projet موضوع اقتناء تزويد مشروع",
}

# Sections that a question's words point to, in order.
SECTION_HINTS = [
    (("pénalité", "penalite", "retard", "amende", "غرامة", "تأخير"), ("penalty", "technical")),
    (("garantie", "warranty", "ضمان"), ("technical", "guarantee")),
    (("caution", "cautionnement", "كفالة", "كفيل"), ("guarantee",)),
    (("paiement", "payer", "facture", "virement", "خلاص", "دفع"), ("payment", "financial")),
    (("validité", "validite", "valable", "صلاحية", "سارية المفعول"), ("deadline", "guarantee")),
    (("date limite", "heure limite", "remise des offres", "ouverture", "plis", "soumission", "tuneps", "تونيبس", "envoyer", "depot", "dépôt"), ("admin", "deadline")),
    (("réception", "reception", "installation", "livraison", "validation", "استلام", "تسليم"), ("reception", "technical")),
    (("document administratif", "cnss", "registre", "attestation", "fiscal", "administratif"), ("admin",)),
    (("technique", "spécification", "specification", "documentation technique", "fiche technique"), ("technical",)),
    (("financier", "bordereau", "prix", "lettre de soumission"), ("financial",)),
]

# Weights of terms that a question's focus asks for.
PRIMARY_WEIGHT, SUPPORT_WEIGHT, PENALTY_WEIGHT = 0.22, 0.08, -0.25
# Bonus by page for questions about the subject, and for words of a title.
PAGE_BONUS, TITLE_BONUS = ((1, 0.45), (2, 0.30), (4, 0.15), (None, -0.05)), 0.25
RERANK_FLOOR = 0.01

# Words left out of a question, and words added for others.
STOPWORDS = [
    "a", "about", "an", "and", "are", "as", "at", "au", "aux", "avec", "be", "by", "ce", "ces", "comment", "dans", "de", "des", "do", "does", "du",
    "en", "est", "et", "for", "from", "how", "is", "it", "la", "le", "les", "leur", "leurs", "l", "of", "on", "or", "ou", "par", "pour", "que",
    "quel", "quelle", "quels", "quelles", "qui", "sont", "sur", "the", "this", "to", "un", "une", "what", "when", "where", "which", "who", "why",
    "with",
]
SYNONYMS = {
    "address": ["adresse", "rue", "bp", "siege", "contact"],
    "adresse": ["address", "rue", "bp", "siege", "contact"],
    "amount": ["montant", "prix", "dinars", "dinar"],
    "bank": ["banque", "tsb"],
    "buyer": ["acheteur", "maitre", "ouvrage", "tsb"],
    "client": ["maitre", "ouvrage", "acheteur", "beneficiaire", "tsb"],
    "contact": ["email", "mail", "telephone", "tel", "fax", "adresse"],
    "delivery": ["livraison", "installation", "delai", "execution"],
    "manager": ["responsable", "chef", "maitre", "ouvrage"],
    "owner": ["maitre", "ouvrage", "acheteur", "beneficiaire"],
    "price": ["prix", "montant", "bordereau", "financier"],
    "project": ["projet", "marche", "objet", "maitre", "ouvrage"],
    "qualification": ["participation", "certification", "reference", "references"],
    "required": ["exige", "exiges", "obligatoire", "demande", "demandes"],
    "requirements": ["exigences", "exige", "obligatoire", "conditions"],
    "say": ["article", "stipule", "prevoit", "indique"],
    "who": ["qui", "maitre", "ouvrage", "fournisseur"],
}
PASSAGE_LEAST, ARTICLE_LEAST, ARTICLE_BONUS, NUMBER_HIT = 2.0, 4.0, 8.0, 0.8

# Phrases by which a generated answer gives itself away as guesswork.
GUESSWORK = [
    "généralement", "habituellement", "en général", "il est courant", "typiquement", "on peut supposer", "il est probable",
    "dépend du contexte", "il faudrait consulter", "je recommande de consulter", "il est important de", "peut être requis",
    "peuvent être demandées", "certaines circonstances", "LinkedIn", "Indeed", "Glassdoor", "en France", "selon la nature",
    "il n'y a pas de mention claire", "il est donc recommandé", "the user requested", "the user asked", "respond in english",
    "answer in english",
]

# Quality modes of a document's text.
ARABIC_LEAST, ARABIC_READABLE, READABLE_LEAST = 0.08, 0.68, 0.55
# Fixed value: least share of a quote's words for an approximate match.
QUOTE_SHARE = 0.55

# An anchor and the values that make it a signal, in Arabic text.
ARABIC_SIGNALS = [
    ("أمر بصرف", ["30", "ثلاثون"]),
    ("غرامة التأخير", ["965", "5 96", "5%"]),
    ("خطايا التأخير", ["965", "5 96", "5%"]),
    ("الضمان النهائي", ["903", "3 96", "3%"]),
    ("ضمان نهائي", ["903", "3 96", "3%"]),
    ("العرض الفني", ["ISO", "9001", "14001", "1590", "1509001", "جذاذات فنية"]),
]
# Signs of table debris in a list's item, and its greatest number of bars and equals signs.
ITEM_NOISE, ITEM_LEAST, ITEM_SYMBOLS = ["authentifications", "designations", "cachet signature", "soumissionnaire reg p", "fu 3"], 8, 3

# Markers of a page's quality and their weights; hints of a document whose Arabic was not read, and their penalty.
QUALITY_MARKERS = [
    "appel d'offres", "appel d offres", "cahier des charges", "date limite", "soumission", "offre technique", "offre financiere",
    "offre financière", "bordereau des prix", "caracteristiques techniques", "caractéristiques techniques",
]
ARABIC_QUALITY_MARKERS = ["كراس الشروط", "طلب عروض", "العروض", "الصفقة", "الضمان", "آخر أجل", "منظومة تونابس", "تونابس", "منظومة الشراء"]
SMALL_QUALITY_MARKERS = ["tuneps", "www.tuneps.tn", "prix", "qte", "qté", "minimum demandé"]
UNREAD_ARABIC_HINTS = ["tuneps", "republique tunisienne", "république tunisienne", "ministere", "ministère", "office de"]
QUALITY_WEIGHTS, UNREAD_PENALTY, UNREAD_ARABIC = (16, 18, 8), -35, 0.01
# Eight of the nine Arabic markers count twice: the score is defined on a list that has them twice.
ARABIC_MARKERS_TWICE = ["كراس الشروط", "طلب عروض", "العروض", "الصفقة", "الضمان", "آخر أجل", "منظومة تونابس", "تونابس"]

# What recognition makes of Arabic words, and the words, in the order in which they are replaced.
ARABIC_OCR = [
    ("منظومق", "منظومة"), ("العموميه", "العمومية"), ("علو الخط", "على الخط"), ("علو الشرف", "على الشرف"), ("لسجل الوطني", "السجل الوطني"),
    ("توزيبس", "تونبس"), ("توزيهبس", "تونبس"), ("غرامق", "غرامة"), ("الت خير", "التأخير"), ("مدق", "مدة"), ("صلويته", "صلاحيته"),
    ("صلوية", "صلاحية"), ("سنق", "سنة"), ("وشيقة", "وثيقة"), ("وشائق", "وثائق"), ("بطاقق", "بطاقة"), ("الفنيق", "الفنية"),
    ("الفني6", "الفنية"), ("المال ية", "المالية"), ("جلسق", "جلسة"), ("واحدق", "واحدة"), ("لجنق", "لجنة"), ("الإدارق", "الإدارة"),
    ("اإعلامية", "الإعلامية"), ("االستلام", "الاستلام"), ("لنهائي", "النهائي"), ("االنهائي", "النهائي"), ("الأشمان", "الأثمان"),
    ("الشركق", "الشركة"), ("الصتفقق", "الصفقة"), ("الصتفقة", "الصفقة"), ("المسلوق", "المسلمة"),
]
# Misread percentages, and what must follow them.
ARABIC_PERCENT = [("903", "3 96", "القيمة|القيم|المبلغ|مبلغ"), ("965", "5 96", "مبلغ|المبلغ|الحساب")]

# Least number of evidence pages by group of fields, in general and by a text's quality mode.
GROUP_PAGES = {"documents": 8, "guarantees": 7, "execution": 8}
MODE_GROUP_PAGES = {
    "arabic_noisy": {"submission": 12, "documents": 16, "guarantees": 14, "execution": 14},
    "noisy_ocr": {"submission": 8, "documents": 12, "guarantees": 10, "execution": 10},
    "partial_pages": {"submission": 8, "documents": 10, "guarantees": 10, "execution": 10},
}
NARROW_PAGES = 5

# Keys of a record of facts that are no facts.
NO_FACTS = ["summary", "tender_profile", "extraction_warning"]
# By language, the answer where nothing is found and the instruction to answer in it.
MISSING_ANSWERS = {"ar": "غير مذكور في هذه الوثيقة.", "en": "Not mentioned in this document.", "fr": "Non mentionne dans ce document."}
LANGUAGE_INSTRUCTIONS = {"ar": "Reponds uniquement en arabe.", "en": "Answer only in English.", "fr": "Reponds uniquement en francais."}
# Words by which a question is English.
ENGLISH_MARKERS = [
    "what", "which", "when", "where", "who", "whom", "whose", "how", "does", "do", "is", "are", "deadline", "warranty", "payment",
    "penalties", "documents required", "bid", "tender", "offer validity", "opening of bids",
]

# Phrases by which a normalised question is of a kind, as whole words.
QUESTION_KINDS = {
    "subject": [
        "sujet", "objet", "l'objet", "l objet", "objet de la consultation", "intitule", "titre", "de quoi s agit", "de quoi s'agit",
        "de quoi parle", "c'est quoi", "c est quoi", "concerne quoi", "what is this about", "what is the tender about",
        "what is the document about", "what does this concern", "purpose", "subject", "title",
    ],
    "deadline": [
        "date limite", "date de remise", "remise des offres", "delai de remise", "dernier delai", "dernier jour", "au plus tard",
        "quand deposer", "quand soumettre", "quand envoyer", "submit the offer", "submit offers", "submission date", "submission deadline",
        "last date", "last day", "deadline", "due date", "closing date",
    ],
    "summary": [
        "resume", "resumer", "resumee", "summary", "summarize", "summarise", "points cles", "points cle", "key points", "main points",
        "overview", "tell me about", "explique", "explain", "de quoi parle",
    ],
    "organization": [
        "quelle est ce societe", "quelle est cette societe", "quel est ce societe", "c est quelle societe", "c'est quelle societe",
        "quelle societe", "nom de la societe", "quelle entreprise", "nom de l entreprise", "quelle banque", "quel organisme",
        "quelle organisme", "quelle institution", "what company", "which company", "what is this company", "company name", "which bank",
        "what organization", "which organization",
    ],
    "assistant": [
        "qui es tu", "qui etes vous", "t es qui", "tu es qui", "c est qui", "c'est qui", "presente toi", "presentez vous",
        "quel est ton nom", "comment tu t appelles", "comment vous appelez vous", "who are you", "who are u", "who r u", "who r you",
        "what are you", "what are u", "what r u", "what r you", "your name", "introduce yourself", "chkoun enti", "chkun enti", "chnowa enti",
    ],
}
# A word of the first list together with a phrase of the second asks for the organization.
ORGANIZATION_WORDS = ["societe", "soci", "entreprise", "organisme", "company"]
ORGANIZATION_SHAPES = ["quelle est ce", "quelle est cette", "c est quelle", "c'est quelle", "what is this", "which"]
# Words, one of each list of which together ask who answers.
ASSISTANT_WORDS = [["who", "what"], ["u", "you"], ["are", "r"]]

# What ends an answer taken from a text, and what stands before it, in order.
ANSWER_STOP = r"(?:\.\s+[A-Z][^a-z]|\.\s+Messieurs\b|\.\s+Madame\b|\.\s+\d+\b|\s+\d+\.\s+[A-Z]|\n|$)"
_ARTICLE_HEAD = r"\barticle\s*\d+\s*[:\-]?\s*objet(?:\s+(?:du|de\s+la|de\s+l['’])\s+(?:march[eé]|consultation|cahier\s+des\s+charges))?\s*[:\-]?\s*"
_PURPOSE = r"\b(?:la\s+)?(?:pr[eé]sente\s+)?consultation\s+a\s+pour\s+objet\s+"
_TENDER_PURPOSE = r"\b(?:le\s+)?(?:pr[eé]sent\s+)?(?:march[eé]|appel\s+d['’]offres?|cahier\s+des\s+charges)\s+a\s+pour\s+objet\s+"
_OBJECT = r"\bobjet(?:\s+de\s+la\s+consultation)?\s*[:\-]\s*"
_CONSULTATION = r"\bconsultation\s+pour\s+"
_PURCHASE = r"\bmarch[eé]\s+d[' ]acquisition\s+"
_RENEWAL = r"\brenouvellement\s+des\s+licences\s+"
DIRECT_HEADS = {
    "subject": [
        _ARTICLE_HEAD, _PURPOSE, _TENDER_PURPOSE, r"\bporte\s+sur\s+", _OBJECT, _CONSULTATION, r"\bdemande d[' ]offre de prix\s+",
        _PURCHASE, _RENEWAL,
    ],
    "deadline": [r"\bdate\s+limite(?:\s+de\s+remise\s+des\s+offres)?\s*[:\-]\s*", r"\bremise\s+des\s+offres\s*[:\-]\s*"],
}
# Heads of a summary's first part, and what is put before what follows them.
SUMMARY_HEADS = [
    (_ARTICLE_HEAD, ""), (_PURPOSE, ""), (_TENDER_PURPOSE, ""), (_OBJECT, ""), (_CONSULTATION, "Consultation pour "),
    (_PURCHASE, "Marche d'acquisition "), (_RENEWAL, "Renouvellement des licences "),
]
SUMMARY_ITEMS, SUMMARY_ITEM_LEAST, SUMMARY_SENTENCE_LEAST, SUMMARY_PARTS = 3, 3, 20, 2
SUMMARY_LISTED, SUMMARY_DEADLINE = "Elements cites : ", "Date limite : "

# What speaks for a subject, all words of an entry together, in lower case and folded; and what against it.
SUBJECT_SIGNS = [(100, ["se propose", "acqu"]), (120, ["a pour objet"]), (80, ["consultation pour"])]
SUBJECT_FOLDED_SIGNS = [
    (170, ["tsb envisage"]), (90, ["infrastructure systeme"]), (180, ["topnet", "solution antivirale"]),
    (100, ["securite des infrastructures informatiques"]), (60, ["edr"]), (90, ["fourniture et la livraison"]),
    (180, ["solution d'impression", "multifonction"]),
]
SUBJECT_TENDER, SUBJECT_TENDER_WEIGHT = ["lance le present appel d'offres", "en lot unique pour l'acquisition"], 80
SUBJECT_REFUSED, SUBJECT_REFUSED_WEIGHT = [
    "je joins", "presente soumission", "présente soumission", "cahier des clauses", "attestation fiscale", "attestation d'affiliation",
    "fixent les procedures", "procedures de l'appel d'offres", "stipulent les conditions du marche", "definissent les conditions",
    "regissent les rapports", "precisent les obligations", "determinent les modalites", "fixent les conditions",
    "definissent les droits", "approuver les rapports", "delivrer les certificats",
], -160
SUBJECT_CONTENTS, SUBJECT_CONTENTS_WEIGHT = [
    "etcompositiondel", "compositiondelappeld", "composition de l appel d offres", "table des matieres", "sommaire",
], -260
SUBJECT_DIGIT, SUBJECT_SHORT, SUBJECT_EARLY, SUBJECT_ARTICLES, SUBJECT_ANNEX, SUBJECT_LEADERS, SUBJECT_LIST = 30, -40, 60, -300, -180, -220, -260

# The questions of the checklist, their fields, and whether the answer is yes or no first.
CHECKLIST = [
    ("Quel est l'objet du cahier des charges / de la presente consultation ?", "subject", False),
    ("Quel est le mode d'envoi ou de depot de la soumission ?", "submission_method", False),
    ("Quelle est la date limite reelle de soumission ?", "deadline", False),
    ("Quelle est la duree de validite de l'offre ?", "validity", False),
    ("Quelle est la date / modalite d'ouverture des plis ?", "opening", False),
    ("Les variantes sont-elles autorisees ?", "variants", False),
    ("Quel est le montant / l'exigence de la caution provisoire ?", "caution", False),
    ("Une fiche de renseignements est-elle exigee ?", "information_sheet", True),
    ("Une attestation d'affiliation a la CNSS est-elle exigee ?", "cnss", True),
    ("Une attestation de solde / situation fiscale est-elle exigee ?", "fiscal_certificate", True),
    ("Un extrait du registre de commerce / certificat RNE est-il exige ?", "rne", True),
    ("Quels sont les documents administratifs exiges ?", "administrative_documents", False),
    ("Quelle documentation technique est exigee ?", "technical_documents", False),
    ("Une autorisation du constructeur / fabricant est-elle exigee ?", "manufacturer_authorization", True),
    ("Une liste de references est-elle exigee ?", "references", True),
    ("Quels sont les documents financiers exiges ?", "financial_documents", False),
    ("Quelle est la periode de garantie exigee ?", "guarantee", False),
    ("Quelles sont les modalites / types de reception ?", "reception", False),
    ("Une caution definitive est-elle exigee ?", "definitive_caution", True),
    ("Existe-t-il des penalites de retard ?", "penalties", True),
    ("Quelles sont les modalites de paiement ?", "payment", False),
]
# Long values of the checklist are told short from these lengths on, by these words.
RECEPTION_LEAST, GUARANTEE_LEAST, GUARANTEE_MOST = 350, 260, 4
# Signs that variants are refused, in a text without punctuation.
VARIANTS_REFUSED = ["ne sont pas", "pas autorise", "interdite", "non autorise", "sans variante"]
RECEPTION_TYPES = ["reception quantitative", "reception provisoire", "reception definitive"]
RECEPTION_DETAILS = [
    ("apres livraison", ["livraison"]),
    ("apres verification de conformite", ["verification", "conformite", "specifications techniques", "tests"]),
    ("a l'expiration du delai de garantie", ["delai de garantie", "expiration du delai"]),
]
DURATION = r"\b(?:\d{1,3}|un|une|deux|trois|six|douze|vingt\s+quatre|trente\s+six)(?:\s*\(\s*\d{1,3}\s*\))?\s*(?:mois|ans?|ann[ée]es?)\b"

# A row of a price schedule, what a page with one has, and how a fact ends before the next section.
PRICE_ROW = r"\b(\d{1,2})\s+([A-ZÀ-ÖØ-öø-ÿ][\wÀ-ÖØ-öø-ÿ'’()./+&\-\s]{4,220}?)\s+Unit[eé]\s+(\d+(?:[.,]\d+)?)\b"
PRICE_PAGES, PRICE_LOT = ["bordereau des prix", "prix u"], r"\bLOT\s*(\d+)\s*:?\s*[^:]{0,120}?(?=\s+Item|\s*$)"
SECTION_STARTS = r"ARTICLE\s+\d+|(?:LA\s+)?DATE\s+LIMITE|OUVERTURE\s+DES\s+(?:PLIS|OFFRES)|MODALIT[EÉ]S?\s+DE\s+PAIEMENT|P[EÉ]NALIT[EÉ]S?"

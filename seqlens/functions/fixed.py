"""Word lists, tables and patterns that results depend on, in their natural order."""

from __future__ import annotations

# The label registry, a row each: label | status | reported in humans | note.
REGISTRY = [
    ("ST1", "accepted", "yes", "Most prevalent globally; IBS association"),
    ("ST2", "accepted", "yes", "Common in humans; urticaria association"),
    ("ST3", "accepted", "yes", "Most prevalent globally; IBS-D association"),
    ("ST4", "accepted", "yes", "Europe-dominant; possible immunoprotective role"),
    ("ST5", "accepted", "yes", "Predominantly pigs; zoonotic in humans"),
    ("ST6", "accepted", "yes", "Primarily birds/poultry"),
    ("ST7", "accepted", "yes", "Primarily birds/poultry"),
    ("ST8", "accepted", "yes", "Non-human primates; rare in humans"),
    ("ST9", "accepted", "yes", "Human-specific; rare"),
    ("ST10", "accepted", "yes", "Artiodactyls; rare human reports; now split ST42-44"),
    ("ST11", "accepted", "no", "Non-human primates"),
    ("ST12", "accepted", "yes", "Non-human primates; occasional in humans"),
    ("ST13", "accepted", "yes", "Rare; occasional human reports"),
    ("ST14", "accepted", "yes", "Cattle/artiodactyls; rare in humans"),
    ("ST15", "accepted", "no", "Non-human primates"),
    ("ST16", "accepted", "yes", "Rare; occasional human reports"),
    ("ST17", "accepted", "no", "Rodents; cattle"),
    ("ST18", "contested", "no", "Proposed invalid — likely chimeric"),
    ("ST19", "contested", "no", "Proposed invalid — likely chimeric"),
    ("ST20", "contested", "no", "Proposed invalid — likely chimeric"),
    ("ST21", "accepted", "no", "Avian; accepted after full-length validation"),
    ("ST22", "contested", "no", "Proposed invalid — likely chimeric"),
    ("ST23", "accepted", "yes", "Reported in humans (Colombia, Thailand)"),
    ("ST24", "tentative", "no", "Cattle (USA)"),
    ("ST25", "tentative", "no", "Cattle"),
    ("ST26", "accepted", "no", "Cattle (USA); dominant in several US states"),
    ("ST27", "accepted", "no", "Full-length MinION validated"),
    ("ST28", "accepted", "no", "Full-length MinION validated"),
    ("ST29", "accepted", "no", "Full-length MinION validated"),
    ("ST30", "tentative", "no", "Limited data"),
    ("ST31", "tentative", "no", "Limited data"),
    ("ST32", "tentative", "no", "Limited data"),
    ("ST33", "tentative", "no", "Limited data"),
    ("ST34", "tentative", "no", "Limited data"),
    ("ST35", "accepted", "yes", "Human isolate 168; Nanopore full-length validated"),
    ("ST36", "accepted", "no", "Wild bat (S. lilium)"),
    ("ST37", "accepted", "no", "Wild rodent (Heteromyidae)"),
    ("ST38", "accepted", "no", "European water vole"),
    ("ST39", "tentative", "no", "Recently proposed"),
    ("ST40", "tentative", "no", "Recently proposed; Algeria study"),
    ("ST41", "tentative", "yes", "Reported in humans (China 2024)"),
    ("ST42", "accepted", "no", "ST10 split; Santin et al. 2024"),
    ("ST43", "accepted", "no", "ST10 split; Santin et al. 2024"),
    ("ST44", "accepted", "no", "ST10 split; Santin et al. 2024"),
    ("NMAST1", "avian_nmast", "no", "Non-mammalian avian ST"),
    ("NMAST2", "avian_nmast", "no", "Non-mammalian avian ST"),
    ("NMAST3", "avian_nmast", "no", "Non-mammalian avian ST"),
    ("NMAST4", "avian_nmast", "no", "Non-mammalian avian ST"),
    ("NMAST5", "avian_nmast", "no", "Non-mammalian avian ST"),
    ("NMAST6", "avian_nmast", "no", "Non-mammalian avian ST"),
    ("NMAST7", "avian_nmast", "no", "Non-mammalian avian ST"),
    ("NMAST8", "avian_nmast", "no", "Non-mammalian avian ST"),
]

# Labels that the literature gives to accessions.
CURATED_LABELS = {"AB070987": "ST1", "U51151": "ST1"}

# Sequencing technologies and the patterns that show them; the first class that matches is taken.
TECHNOLOGIES = [
    ("Sanger", [
        r"sanger",
        r"capillar[y]?\s+sequenc",
        r"abi\s*(?:prism|3[0-9]{2,3}(?:xl)?)",
        r"\b3500xl?\b",
        r"\b3730xl?\b",
        r"\b377\b\s*(?:dna\s*sequenc)?",
        r"dye.?terminator",
        r"\bbigdye\b",
        r"conventional\s+sequenc",
        r"direct\s+sequenc",
        r"chain.?termination",
    ]),
    ("Illumina", [
        r"illumina",
        r"\bmiseq\b",
        r"\bhiseq\b",
        r"\bnextseq\b",
        r"\bnovaseq\b",
        r"\biseq\b",
        r"\bminiseq\b",
        r"\bgenome\s+analyz?er\b",
        r"\bgaii+\b",
        r"short.?read\s+sequenc",
        r"paired.?end\s+sequenc",
    ]),
    ("ONT", [
        r"oxford\s+nanopore",
        r"\bont\b",
        r"\bnanopore\b",
        r"\bminion\b",
        r"\bgridion\b",
        r"\bpromethion\b",
        r"\bflongle\b",
        r"long.?read.*nanopore",
    ]),
    ("PacBio", [
        r"pacbio",
        r"pacific\s+biosciences",
        r"\bsmrt\b",
        r"\bsequel\s*ii?e?\b",
        r"\brs\s*ii\b",
        r"\brsii\b",
        r"\brevio\b",
    ]),
    ("Ion Torrent", [
        r"\bion\s*torrent\b",
        r"\biontorrent\b",
        r"\bion\s*pgm\b",
        r"\bion\s*proton\b",
        r"\bion\s*(?:gene)?studio\b",
        r"\bion\s*s5\b",
        r"\bion\s*chef\b",
        r"thermo.*ion",
        r"life\s*tech.*ion",
    ]),
    ("BGI/MGI", [
        r"\bbgi\s*seq",
        r"\bbgiseq\b",
        r"\bmgi\s*seq",
        r"\bmgiseq\b",
        r"\bdnb\s*seq",
        r"\bdnbseq\b",
        r"\bbgi[\s-]*tech",
        r"\bcomplete\s+genomics\b",
    ]),
    ("Element AVITI", [
        r"\belement\s+aviti\b",
        r"\baviti\b",
        r"\belement\s+bioscience",
    ]),
    ("Singular G4", [
        r"\bsingular\s+g4\b",
        r"\bsingular\s+genomics\b",
    ]),
    ("Ultima", [
        r"\bultima\s+genomics\b",
        r"\bug100\b",
    ]),
    ("454/Pyrosequencing", [
        r"\b454\b",
        r"pyrosequenc",
        r"roche\s+454",
        r"gs.?flx",
        r"gs.?junior",
        r"genome\s+sequencer\s+(?:flx|junior)",
    ]),
    ("SOLiD", [
        r"\bsolid\s*(?:[345]\d{2}|system|sequenc)",
        r"applied\s+biosystems\s+solid",
    ]),
    ("Helicos", [
        r"\bhelicos\b",
        r"\bheliscope\b",
        r"true\s+single\s+molecule",
    ]),
]

# Parts of the names of structured comments that tell of sequencing.
STRUCTURED_KEYS = [
    "sequencing technology",
    "sequencing-technology",
    "sequencing_technology",
    "sequencing platform",
    "sequencing-platform",
    "assembly method",
    "instrument",
    "platform",
    "sequencing instrument",
    "sequencing kit",
    "library construction",
    "library preparation",
]

# Host names that name no host; the genus under study adds its own two.
GENERIC_HOSTS = ["", "unknown", "n/a", "na", "not applicable", "none", "missing", "not collected", "not available"]

# Host names and what they stand for.
HOSTS = {
    "human": "Homo sapiens",
    "humans": "Homo sapiens",
    "homo sapien": "Homo sapiens",
    "homo sapiens": "Homo sapiens",
    "cattle": "Bos taurus",
    "cow": "Bos taurus",
    "bovine": "Bos taurus",
    "bos taurus": "Bos taurus",
    "calf": "Bos taurus",
    "beef cattle": "Bos taurus",
    "dairy cattle": "Bos taurus",
    "pig": "Sus scrofa",
    "swine": "Sus scrofa",
    "domestic pig": "Sus scrofa domesticus",
    "sus scrofa": "Sus scrofa",
    "sus scrofa domesticus": "Sus scrofa domesticus",
    "piglet": "Sus scrofa domesticus",
    "sheep": "Ovis aries",
    "domestic sheep": "Ovis aries",
    "ovis aries": "Ovis aries",
    "lamb": "Ovis aries",
    "ewe": "Ovis aries",
    "goat": "Capra hircus",
    "capra hircus": "Capra hircus",
    "chicken": "Gallus gallus",
    "gallus gallus": "Gallus gallus",
    "fowl": "Gallus gallus",
    "broiler": "Gallus gallus",
    "domestic chicken": "Gallus gallus",
    "camel": "Camelus dromedarius",
    "dromedary": "Camelus dromedarius",
    "camelus dromedarius": "Camelus dromedarius",
    "horse": "Equus caballus",
    "donkey": "Equus asinus",
    "dog": "Canis lupus familiaris",
    "cat": "Felis catus",
    "gibbon": "Hylobates lar",
    "monkey": "Primates sp.",
    "macaque": "Macaca sp.",
    "chimpanzee": "Pan troglodytes",
    "gorilla": "Gorilla gorilla",
    "orangutan": "Pongo pygmaeus",
    "rat": "Rattus sp.",
    "mouse": "Mus musculus",
    "rattus norvegicus": "Rattus norvegicus",
    "muskox": "Ovibos moschatus",
    "ovibos moschatus": "Ovibos moschatus",
    "ctenodactylus gundi": "Ctenodactylus gundi",
    "yak": "Bos grunniens",
    "buffalo": "Bubalus bubalis",
    "water buffalo": "Bubalus bubalis",
    "alpaca": "Vicugna pacos",
    "llama": "Lama glama",
    "reindeer": "Rangifer tarandus",
    "elk": "Cervus canadensis",
    "deer": "Cervidae sp.",
    "duck": "Anas platyrhynchos",
    "goose": "Anser anser",
    "turkey": "Meleagris gallopavo",
    "bat": "Chiroptera sp.",
}

# Species of the genus under study that are named for their host; the first that an organism's name holds is taken.
SPECIES_HOSTS = {
    "hominis": "Homo sapiens",
    "ratti": "Rattus norvegicus",
    "galli": "Gallus gallus",
    "lapemi": "Lapemis hardwickii",
    "pythoni": "Python reticulatus",
    "anatis": "Anas platyrhynchos",
    "anseri": "Anser anser",
}

# Words of an isolation source that name an animal, and words that name a kind of sample; each list is one alternation, in its order, of the patterns
# that metadata and its SQL make of it.
ANIMAL_WORDS = ["human", "cattle", "cow", "pig", "swine", "sheep", "goat", "chicken", "camel", "horse", "dog", "cat", "bird", "monkey", "gibbon", "rat", "mouse", "muskox", "gundi", "reindeer", "bovine", "porcine", "caprine", "ovine", "poultry", "fowl", "deer", "buffalo", "yak", "alpaca", "llama", "chimpanzee", "gorilla", "orangutan", "macaque", "bat", "hominid"]
SAMPLE_WORDS = ["feces", "faeces", "stool", "soil", "water", "sewage", "sludge", "manure", "gut", "intestine", "colon", "cecum", "environment", "culture", "laboratory", r"fecal\s+sample", r"fecal\s+matter"]

# How notes tell a host; the first pattern captures its name, the others say human.
NOTE_HOSTS = [r"\bisolate(?:d)?\s+from\s+(?:the\s+)?(?:a\s+)?([a-zA-Z][a-zA-Z\s]+?)\b", r"\bfrom\s+(?:a\s+)?human\b", r"\bhuman\s+(?:fecal|stool|isolate)\b"]

# Accession prefixes of predicted and derived records, and molecule types that are taken.
PREDICTED_PREFIXES = ["XM_", "XR_", "XP_", "NM_", "NR_", "NP_", "YP_", "WP_"]
MOLECULE_TYPES = ["", "genomic dna", "rrna", "trna", "dna", "transcribed rna", "other rna", "ss-rna", "ds-rna", "unassigned rna", "genomic rna"]

# Disease contexts and the patterns that show them, in order of report.
DISEASES = {
    "colorectal_cancer": r"colorectal|colon\s+cancer|rectal\s+cancer|\bCRC\b|adenoma|colonic\s+neoplas|bowel\s+cancer|intestinal\s+polyp",
    "other_cancer": r"\bcancer\b|carcinoma|leukemi|lymphoma|malignan|tumou?r|oncolog|chemotherap",
    "ibs": r"irritable\s+bowel|\bIBS\b",
    "ibd": r"inflammatory\s+bowel|\bIBD\b|crohn|ulcerative\s+colitis",
    "diarrhea_gi": r"diarrh|gastroenteritis|dysenter|gastrointestinal\s+symptom|abdominal\s+pain|digestive\s+(disorder|symptom)|\bvomit|flatulen|bloating|dyspep",
    "urticaria_skin": r"urticaria|\brash\b|pruritus|angioedema|dermatolog",
    "immunocompromised": r"\bHIV\b|\bAIDS\b|immunocompromis|immunosuppress|immunodefic|transplant|h(a)?emodialysis|dialysis",
    "anemia_nutrition": r"an(a)?emi[ac]|malnutrition|malnourish|stunting|iron\s+(status|deficien)",
    "healthy_control": r"healthy|asymptomatic|control\s+(group|subject|individual)|non[-\s]?symptomatic|without\s+(gastrointestinal\s+)?symptom",
    "symptomatic_unspec": r"symptomatic\s+(patient|subject|individual|carrier)|\bpatient(s)?\b",
}
#: Dropped if any other is found; and the general one that gives way to the special one.
WEAK_DISEASE = "symptomatic_unspec"
SPECIAL_DISEASE, GENERAL_DISEASE = "colorectal_cancer", "other_cancer"

# Thresholds.
MIN_LENGTH, MAX_LENGTH, SHORT_MIN, SHORT_MAX = 1000, 2500, 100, 999
PLACEMENT_REJECT, PLACEMENT_LOW, PLACEMENT_MEDIUM = 0.30, 0.15, 0.08
MAPPING_HIGH, MAPPING_MEDIUM, MAPPING_LOW = 0.05, 0.15, 0.30
NOVEL_CUTOFF, NOVEL_MIN_SIZE = 0.20, 2
CLUSTER_CUTS = {"cluster_top": 0.05, "cluster_subtype": 0.025, "cluster_variant": 0.01}
OUTLIER_MULTIPLIER, OUTLIER_FLOOR, DOMINANT_SHARE = 3.0, 0.002, 0.6
KMER, MATRIX_KMER = 8, 6

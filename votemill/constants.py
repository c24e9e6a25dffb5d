"""Fixed values of the domain: value domains, thresholds and word lists.

Everything here is data, not logic.  Operators take these as default
arguments, so another parliament (or the test bindings) passes its own.
"""

from __future__ import annotations

# --- value domains (fixed values) -------------------------------------------
YES, NO, BLANK, ABSENT = "Jaa", "Ei", "Tyhjää", "Poissa"
SUBSTANTIVE = (YES, NO)
CAST_VALUES = (YES, NO, BLANK)
LINE_TIE, LINE_UNDEFINED = "TIE", "UNDEFINED"
FOLLOWS, DEVIATES, CLASS_ABSENT, INELIGIBLE = "follows", "deviates", "absent", "ineligible"
STANCE_FOR, STANCE_AGAINST, STANCE_COND, STANCE_NONE = "puolesta", "vastaan", "ehdollinen", "ei_kantaa"
STANCES = (STANCE_FOR, STANCE_AGAINST, STANCE_COND, STANCE_NONE)
ALIGNED, CONFLICT, RELUCTANT, CONTEXT, INSUFFICIENT = (
    "linjassa", "ristiriita", "vastentahtoinen", "konteksti", "ei_riitä")
ALIGNMENT_PRIORITY = (CONFLICT, RELUCTANT, ALIGNED, CONTEXT, INSUFFICIENT)
CONF_HIGH, CONF_MID, CONF_LOW = "korkea", "kohtalainen", "matala"
RAW_VALUE_ALIASES = {"Tyhjiä": BLANK}

# --- thresholds (fixed values) ----------------------------------------------
WINDOW_DAYS = 30
WEIGHT_ALIGNMENT, WEIGHT_LINE = 0.5, 0.5
CONF_FULL_ELIGIBLE, CONF_FULL_SPEECHES = 50, 20
CONF_HIGH_MIN, CONF_MID_MIN = 0.66, 0.33
LOW_SAMPLE_BELOW = 10
MIN_CHANGE_GAP_DAYS = 7
TOPIC_HARD_THRESHOLD, TOPIC_DOMINANCE, TOPIC_MAX_PER_ITEM, TOPIC_MIN_TOKENS = 0.15, 0.40, 3, 25
WORDS_MIN_COUNT, WORDS_TOP_N, WORDS_MIN_LEN, WORDS_PRIOR, WORDS_MIN_PARTY_TOTAL = 30, 30, 3, 1000.0, 20000
CONFLICT_MIN_CONFIDENCE = 0.7
BM25_K1, BM25_B, BM25_IDF_FLOOR = 1.2, 0.75, 1e-6

# --- phrase lists (fixed values) --------------------------------------------
PROCEDURAL_HINTS = (
    "päiväjärjestykseen siirtyminen", "työjärjestys", "asian palauttaminen",
    "pöydällepano", "pöydälle panemisesta", "lähetekeskustelu",
)

RELUCTANCE_MARKERS = (
    "hallitusvastuun vuoksi", "hallitusvastuun nimissä", "vastoin omaa kantaani",
    "vastoin omaa näkemystäni", "en pidä tästä mutta", "en kannata mutta äänestän",
    "äänestän puolesta vaikka", "äänestän vastentahtoisesti", "joudun äänestämään puolesta",
    "hampaat irvessä", "kokonaisuuden vuoksi äänestän", "ryhmäkurin vuoksi",
)

PASSAGE_YES_PREFIXES = ("hyväksy", "mietintö")
PASSAGE_NO_PARTS = ("hylk", "hyljät")

# --- topic lexicon (fixed values): id, slug, label, keyword prefixes and weights ---
TOPIC_LEXICON = (
    (1, "talous", "Talous", [
        ("talous", 1.0), ("budjet", 1.5), ("julkis talou", 2.0), ("alijääm", 1.5), ("velka", 1.0),
        ("brutto kansan", 1.5), ("suhdann", 1.0), ("valtiontalou", 1.5),
    ]),
    (2, "terveydenhuolto", "Terveydenhuolto", [
        ("terveydenhuol", 2.0), ("sairaal", 1.5), ("soten", 1.5), ("sote", 1.5), ("hoito takuu", 2.0),
        ("hoitotakuu", 2.0), ("lääk", 1.0), ("hoitaj", 1.0), ("terveys asem", 1.5), ("potilas", 1.0),
    ]),
    (3, "koulutus", "Koulutus", [
        ("koulut", 1.5), ("opetu", 1.5), ("oppivelvol", 2.0), ("yliopist", 1.5), ("ammattikorkea", 1.5),
        ("varhaiskasvat", 2.0), ("opiskel", 1.0), ("oppimi", 1.0),
    ]),
    (4, "ilmasto", "Ilmasto ja ympäristö", [
        ("ilmast", 1.5), ("päästö", 1.5), ("hiilineutr", 2.0), ("luonnon suojel", 2.0), ("luonnonsuojel", 2.0),
        ("monimuoto", 1.5), ("ympäristö", 1.0), ("kasvihuone", 1.5), ("luontokato", 2.0),
    ]),
    (5, "maahanmuutto", "Maahanmuutto", [
        ("maahanmuut", 2.0), ("turvapaik", 2.0), ("pakolais", 1.5), ("kotoutu", 1.5), ("oleskelulu", 2.0),
        ("työperäi maahan", 2.0), ("rajamenet", 1.5),
    ]),
    (6, "turvallisuus", "Turvallisuus ja puolustus", [
        ("puolust", 1.5), ("maanpuolus", 2.0), ("nato", 1.5), ("asevelvol", 2.0), ("sotilas", 1.0),
        ("kriisinhal", 1.5), ("varuskun", 1.5), ("sisäinen turval", 2.0),
    ]),
    (7, "sosiaaliturva", "Sosiaaliturva", [
        ("sosiaalitur", 2.0), ("toimeentulotu", 2.0), ("perustur", 1.5), ("työttömyysturv", 2.0), ("eläke", 1.5),
        ("lapsilis", 2.0), ("asumistu", 1.5), ("perustulo", 2.0),
    ]),
    (8, "verotus", "Verotus", [
        ("verot", 1.5), ("tulover", 2.0), ("arvonlisäver", 2.0), ("yhteisöver", 2.0), ("veron koroitu", 2.0),
        ("veroaste", 1.5), ("pääomatulover", 2.0),
    ]),
    (9, "eu", "EU", [
        ("euroopan unio", 2.0), ("eu komiss", 2.0), ("eu rahast", 1.5), ("eu jäsen", 1.5), ("sisämarkkin", 1.5),
        ("eu direkt", 2.0), ("euroopan parlament", 2.0),
    ]),
    (10, "maatalous", "Maatalous", [
        ("maatalou", 2.0), ("viljel", 1.5), ("maatil", 1.5), ("maaseut", 1.0), ("ruoan tuotan", 1.5), ("karja", 1.0),
        ("maataloustu", 2.0), ("elintarvike omavarai", 2.0),
    ]),
    (11, "liikenne", "Liikenne", [
        ("liikent", 1.5), ("tie verkko", 1.5), ("rata", 1.0), ("joukkoliiken", 2.0), ("raidelii", 2.0),
        ("väylä", 1.0), ("autoil", 1.5), ("liikenne turval", 1.5),
    ]),
    (12, "asuminen", "Asuminen", [
        ("asumi", 1.5), ("asunto", 1.5), ("vuokra", 1.5), ("kohtuuhintai", 2.0), ("kaavoitu", 1.5),
        ("ara asunto", 2.0), ("asuntopolit", 2.0), ("rakentami", 1.0),
    ]),
    (13, "oikeus", "Oikeus ja sisäasiat", [
        ("oikeus laitos", 2.0), ("rikos", 1.5), ("polii", 1.5), ("tuomioistu", 2.0), ("vankeu", 1.5),
        ("syyttäj", 1.5), ("perus oikeu", 1.5), ("sisä asiat", 1.5),
    ]),
    (14, "tyo", "Työ", [
        ("työllis", 2.0), ("työ markkin", 2.0), ("työ ehto", 1.5), ("lakko", 1.5), ("palkka", 1.0),
        ("työ sopimu", 1.5), ("työttömy", 1.5), ("paikallinen sopimi", 2.0),
    ]),
    (15, "energia", "Energia", [
        ("energi", 1.5), ("sähkö", 1.0), ("ydinvoim", 2.0), ("tuulivoim", 2.0), ("fossiili", 1.5),
        ("energia oma varai", 2.0), ("kantaverkk", 1.5), ("polttoaine", 1.5),
    ]),
    (16, "muu", "Muu / luokittelematon", []),
)
FALLBACK_TOPIC = "muu"
TOPIC_LEXICON_VERSION = "1"

# --- stop words (fixed values): general words and sitting routine ------------
STOPWORDS_GENERAL = (
    "ja", "on", "ei", "että", "se", "tämä", "joka", "mutta", "kun", "niin", "myös", "vaan", "jos", "hän", "me",
    "te", "he", "ne", "sen", "tämän", "olen", "oli", "ollut", "ovat", "olla", "olleet", "onko", "emme", "ette",
    "eivät", "en", "et", "emmekö", "kyllä", "no", "siis", "vielä", "jo", "nyt", "sitten", "tässä", "tuo", "nämä",
    "noita", "näitä", "tätä", "tuota", "arvoisa", "puhemies", "rouva", "herra", "ledamot", "talman", "edustaja",
    "edustajat", "ministeri", "valtioneuvosto", "kysymys", "vastaus", "asia", "asian", "asiaa", "asiat", "salissa",
    "kiitos", "kiitoksia", "minä", "sinä", "hänen", "meidän", "teidän", "heidän", "minun", "sinun", "itse", "oma",
    "omat", "mikä", "mitä", "mikäli", "koska", "jotta", "vai", "tai", "sekä", "eikä", "jotka", "joiden", "joita",
    "jonka", "mihin", "missä", "ihan", "oikein", "todella", "aivan", "juuri", "vain", "vähän", "paljon", "enemmän",
    "kaikki", "kaikkien", "moni", "monet", "tulee", "pitää", "voi", "voidaan", "saada", "tehdä", "ottaa", "antaa",
    "mennä", "tulla", "olisi", "pitäisi", "täytyy", "hyvä", "hyvin", "parempi", "paras", "suuri", "pieni", "uusi",
    "vanha", "sama", "eri", "muu", "muut", "muiden", "tällä", "tällaisia", "tällainen", "sellaisia", "sellainen",
    "sellaista", "tällaista", "jolloin", "siksi", "siten", "näin", "kuten", "esimerkiksi", "muun", "muassa",
    "puhuja", "puheenvuoro", "puheenvuoron", "edellä", "mainittu", "kohta", "pykälä", "momentti", "suomen",
    "suomi", "suomessa", "maan", "maassa", "täällä", "siellä", "tänään", "eilen", "huomenna", "puolue", "puolueen",
    "hallitus", "hallituksen", "oppositio", "eduskunta", "eduskunnan", "prosenttia", "miljoonaa", "miljardia",
    "euroa", "vuoden", "vuonna", "vuotta", "aikana", "osalta", "suhteen",
)

# --- stop words (fixed values): names of the groups themselves ---------------
STOPWORDS_GROUPS = (
    "perussuomalaiset", "perussuomalaisten", "perussuomalainen", "perussuomalaisia", "vihreät", "vihreiden",
    "vihreä", "vihreille", "kokoomus", "kokoomuksen", "kokoomuksessa", "kokoomuksesta", "kokoomuslaiset", "sdp",
    "sosiaalidemokraatit", "sosiaalidemokraattien", "sosialidemokraatit", "demarit", "vasemmistoliitto",
    "vasemmistoliiton", "vasemmistoliitossa", "vasemmisto", "vasemmiston", "keskusta", "keskustan", "keskustassa",
    "keskustalaiset", "kristillisdemokraatit", "kristillisdemokraattien", "rkp", "kokoomuksenkin",
)

# --- style lexicons (fixed values) -------------------------------------------
FILLER_WORDS = (
    "niinku", "niinkun", "niinkö", "tota", "tuota", "tuotanoin", "siis", "tavallaan", "tietysti", "tietenkin",
    "oikeastaan", "periaatteessa", "käytännössä", "öö", "ää", "tuolla", "tämmöinen", "tämmönen", "semmonen",
    "semmoinen", "kaiketi",
)
FILLER_PHRASES = (
    "itse asiassa", "totta kai", "ikään kuin", "niin sanotusti", "niin sanottu", "tota noin",
    "tuota noin", "niin kuin", "sillä tavalla", "sillä lailla", "tuolla tavalla", "no niin",
)
SWEAR_WORDS = (
    "perkele", "perkeleen", "perkelettä", "perkeleet", "perskele", "helvetti", "helvetin", "helvettiä",
    "helvettiin", "helvetissä", "vittu", "vitun", "vittua", "vituttaa", "vitutus", "saatana", "saatanan",
    "saatanaa", "jumalauta", "jumankauta", "jumaliste", "paska", "paskaa", "paskat", "paskan", "paskamainen",
    "paskaks", "hitto", "hiton", "hittoa", "hittolainen", "piru", "pirun", "pirua", "pirut", "pirullinen",
    "perhana", "perhanan", "perhanaa", "saamari", "saamarin", "hemmetti", "hemmetin", "helkkari", "helkkarin",
    "jukra", "jukolauta", "hitsi", "kirottu", "riivattu",
)
SWEAR_PHRASES = ("voi perkele", "voi helvetti")
STYLE_LEXICON_VERSION = "1"

# --- coalition periods (fixed values): start, end (exclusive, None = open), groups
COALITION_PERIODS = (
    ("2015-05-29", "2017-06-13", ["kesk", "kok", "ps"]),
    ("2017-06-13", "2019-06-06", ["kesk", "kok", "sin"]),
    ("2019-06-06", "2023-06-20", ["sd", "kesk", "vihr", "vas", "r"]),
    ("2023-06-20", None, ["kok", "ps", "r", "kd"]),
)

# --- survey party names (fixed values): name to group code --------------------
SURVEY_PARTY_CODES = {
    "kansallinen kokoomus": "kok",
    "kokoomus": "kok",
    "perussuomalaiset": "ps",
    "suomen keskusta": "kesk",
    "keskusta": "kesk",
    "suomen sosialidemokraattinen puolue": "sd",
    "sdp": "sd",
    "vihreä liitto": "vihr",
    "vihreät": "vihr",
    "vasemmistoliitto": "vas",
    "suomen ruotsalainen kansanpuolue": "r",
    "ruotsalainen kansanpuolue": "r",
    "rkp": "r",
    "suomen kristillisdemokraatit": "kd",
    "kristillisdemokraatit": "kd",
    "kd": "kd",
    "liike nyt": "liik",
}
SURVEY_BACKGROUND_COLUMNS = (
    "vaalipiiri", "puolue", "ikä", "sukupuoli", "nimi", "etunimi", "sukunimi",
    "ehdokasnumero", "valittu")

# --- published-result settings (fixed values) ---------------------------------
MATRIX_PARTIES = ("kok", "ps", "kesk", "sd", "vihr", "vas", "r", "kd", "liik", "sin")
OWNERSHIP_PARTIES = ("kok", "ps", "kesk", "sd", "vihr", "vas", "r", "kd")
OTHER_PARTIES = "muut"
TREND_YEARS = tuple(range(2015, 2025))
RATING_YEAR = 2025
RADAR_TOPICS = (
    "talous", "terveydenhuolto", "koulutus", "ilmasto", "maahanmuutto", "turvallisuus",
    "sosiaaliturva", "tyo")
MAP_LEFT, MAP_RIGHT, MAP_UP = "sd", "kok", "vihr"

# --- texts of published results (fixed values) ---------------------------------
NOTE_PROCEDURAL = "menettelyäänestys — ei suoraan lain kannatus"
NOTE_UNCLEAR_VOTE = "ei yksiselitteinen lain sisältöäänestys (esim. lausuma/muutosehdotus)"
NOTE_OPEN_STANCE = "puheen kanta ehdollinen/avoin"
NOTE_ALIGNED = "Jaa = lain hyväksyntä, Ei = hylkäys"
NOTE_CONFLICT = "puheen kanta ja ääni eri suuntiin (hyväksyntä/hylkäys)"
NOTE_UNSURE = "puheen kanta tulkinnanvarainen (matala varmuus) — ei luokitella ristiriidaksi"
NOTE_CHANGE = "sama säädöskohde, eri tilaisuus (vahva signaali) — tarkista molemmat äänestykset"
PROMISE_KEPT, PROMISE_AGAINST, PROMISE_UNCLEAR = "tukee", "ristiriidassa", "epäselvä"
PROMISE_UNMAPPED, PROMISE_MIXED = "ei kartoitettu", "epäselvä (ristiriitainen)"
COVERAGE_TOTAL = "yhteensä"

# --- element names of bill documents (fixed values) ------------------------------
TITLE_TAGS = ("SisaltoKuvaus", "OtsikkoTeksti", "NimekeKooste", "AsiakirjaNimi")

# --- lengths of texts handed on for explaining a bill (fixed values) --------------
EXPLAIN_MAX_SPEECH, EXPLAIN_MAX_SUMMARY = 700, 3000

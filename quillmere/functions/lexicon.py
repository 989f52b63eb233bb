"""Word lists, tables and patterns that results depend on. Every function takes them as parameters with these as defaults."""

# Search and tokens.
STOPWORDS = (
    "och i att det som på är av för med till den har de ett om var än från vid så han hon kan nu men inte eller ska alla när "
    "över under efter utan också varje många mycket denna detta dessa samma vilken vilket vilka bara här där då ju väl nog någon något några"
).split()
MIN_WORD, MAX_WORD = 2, 45
MAX_QUERY = 500
POSTING_CAP = 5000
TERM_CAP = 12

# Ranking.
WEIGHTS = {"tf_idf": 25, "pagerank": 20, "authority": 15, "recency": 15, "density": 10, "structure": 10, "language": 5}
AUTHORITY = {
    ".gov.se": 3.5, "riksdagen.se": 3.5, "regeringen.se": 3.5, "skatteverket.se": 3.0, "migrationsverket.se": 3.0,
    "forsakringskassan.se": 3.0, "arbetsformedlingen.se": 3.0, "folkhalsomyndigheten.se": 3.0, "svt.se": 2.5, "sr.se": 2.5,
    "ur.se": 2.5, "dn.se": 2.0, "svd.se": 2.0, "aftonbladet.se": 1.8, "expressen.se": 1.8, "gp.se": 1.8, "sydsvenskan.se": 1.8,
    ".su.se": 1.8, ".uu.se": 1.8, ".lu.se": 1.8, ".kth.se": 1.8, ".chalmers.se": 1.8, ".liu.se": 1.8, ".gu.se": 1.8, ".se": 1.2,
}
DAMPING, ITERATIONS, DECAY_DAYS = 0.85, 20, 365

# Crawling.
SKIP_EXTENSIONS = "pdf doc docx xls xlsx ppt pptx zip rar tar gz jpg jpeg png gif mp3 mp4 avi mov css js xml json".split()
DOMAINS = {
    "government": "riksdagen.se regeringen.se migrationsverket.se skatteverket.se försäkringskassan.se arbetsförmedlingen.se naturvårdsverket.se trafikverket.se domstol.se rättsmedicinalverket.se krisinformation.se esamverka.se sverige.se prm.se",
    "health": "1177.se akademiska.se apoteket.se folkhälsomyndigheten.se socialstyrelsen.se cancerfonden.se hjartlungfonden.se sjukhusfysiker.se lakemedelsverket.se ivo.se tlv.se sbu.se",
    "education": "kth.se lund.se uu.se gu.se su.se skolverket.se miun.se oru.se lnu.se",
    "news": "svt.se sr.se dn.se aftonbladet.se svd.se expressen.se tt.se etc.se omni.se nyheter24.se svenskbygg.se ekobrottsmyndigheten.se gp.se",
    "local": "stockholm.se malmö.se goteborg.se uppsala.se vgregion.se skane.se helsingborg.se linkoping.se norrköping.se umeå.se gävle.se",
    "business": "bolagsverket.se kammarkollegiet.se prv.se scb.se riksbank.se finansinspektionen.se kkv.se svenskhandel.se teknikforetagen.se chamber.se nek.se tillvaxtverket.se ekobrottsmyndigheten.se",
    "culture": "raa.se nationalmuseum.se fotografiska.se vasamuseet.se si.se visitsweden.com tekniskamuseet.se kb.se",
    "tech": "vinnova.se digg.se datainspektionen.se internetstiftelsen.se pts.se msb.se iva.se",
    "environment": "naturvårdsverket.se havochvatten.se smhi.se svensktvatten.se energimyndigheten.se avfallsverige.se",
    "transport": "trafikverket.se vti.se transportstyrelsen.se sj.se flixbus.se sl.se vasttrafik.se helsingborg.se sundsvall.se",
}
SUGGESTIONS = [
    "svenska nyheter", "arbetsförmedlingen", "migrationsverket", "skatteverket", "försäkringskassan", "csn", "jobb stockholm", "restauranger göteborg",
    "svenska universitet", "regeringen", "riksdagen", "systembolaget", "svt nyheter", "dn senaste", "expressen",
]

# Compound words.
COMPONENTS_V1 = (
    "riks dag ledamot regering minister stat län kommun lands ting region folk myndighet stad borg hamn holm köping by torp berg "
    "arbete tillstånd hem sida tid rum hus plats skola bok bibliotek data web system net telefon mobil bil buss tåg flyg båt "
    "sjö å älv dal skog mark vatten natt morgon kväll år månad vecka sök hitta läs skriv köp sälj arbeta studera "
    "stor liten ny gammal god dålig bra fin"
).split()
MARKERS_V2 = {"s": 0.8, "e": 0.7, "o": 0.6}
COMPONENTS_V3 = (
    "riksdag regering minister ledamot stat lag kommun region myndighet landsting arbete jobb anställ lön tjänst stockholm göteborg malmö "
    "stadt stad borg hamn län område dag natt morgon kväll år månad vecka timme midsommar afton sjuk sjukhus läkare medicin apotek tandvård "
    "skola universitet högskola utbildning studie hus väg plats rum bok system stor liten ny gammal god bra fin försäkring bank affär handel "
    "restaurang tag buss bil cykel flyg båt järnväg sök hitta läs skriv köp sälj tillstånd tillståndet fullt mäktig mäktige kassan verket "
    "myndigheten bolaget"
).split()

# Synonyms of single words.
SYNONYMS = {
    "jobb": ["arbete", "anställning", "sysselsättning", "tjänst"], "arbete": ["jobb", "anställning", "sysselsättning"], "anställning": ["jobb", "arbete", "tjänst"],
    "bostad": ["hem", "lägenhet", "hus", "boende"], "hem": ["bostad", "hus", "boende"], "lägenhet": ["bostad", "hem", "boende"],
    "skola": ["utbildning", "lärande", "undervisning"], "utbildning": ["skola", "studier", "undervisning"], "universitet": ["högskola", "akademi"], "högskola": ["universitet", "akademi"],
    "regering": ["kabinett", "statsråd"], "riksdag": ["parlament", "riksdagen"], "kommun": ["kommunen", "stad", "stadsområde"],
    "söka": ["leta", "hitta", "sök"], "hitta": ["finna", "upptäcka", "söka"], "köpa": ["inhandla", "förvärva", "köp"], "sälja": ["avyttra", "försälja", "sälj"],
    "idag": ["nu", "nuvarande", "aktuellt"], "igår": ["i går", "förra"], "imorgon": ["i morgon", "kommande"],
    "stor": ["big", "omfattande", "betydande"], "liten": ["pytteliten", "minimal", "obetydlig"], "bra": ["god", "fin", "utmärkt", "bäst"], "dålig": ["undermålig", "inferior", "sämst"],
    "pengar": ["kontanter", "medel", "finanser", "kapital"], "pris": ["kostnad", "avgift", "summa"], "betala": ["erlägga", "betalning"],
    "sjuk": ["ill", "sjukdom", "ohälsa"], "hälsa": ["välbefinnande", "hälsotillstånd"], "läkare": ["doktor", "medicinska"],
    "information": ["info", "uppgifter", "data"], "nyhet": ["nyheter", "aktuellt", "notis"], "artikel": ["text", "inlägg", "dokument"],
}

# Query expansion.
EXPANSIONS = {
    "hitta": ["sök", "leta", "söka", "lokalisera", "search", "find"], "ansöka": ["ansökan", "application", "applicera", "register"],
    "registrera": ["registration", "anmäl", "anmälan", "reg"], "få": ["erhålla", "obtain", "get", "hämta"], "skicka": ["submit", "submit", "send", "framlägg"],
    "kontakta": ["ring", "call", "contact", "kommunicera"], "hur": ["sättet", "processen", "stegen", "metoden", "vägen", "process"],
    "steg": ["steps", "stadier", "process", "etapper", "instruktioner"], "ansökan": ["ansöka", "application", "ansökningsprocess"],
    "process": ["processer", "förfarande", "procedure", "arbetssätt"], "riksdag": ["parlament", "parliament", "folkvalda", "ledamöter"],
    "regering": ["government", "regeringen", "statsministern", "ministrar"], "kommun": ["municipality", "kommunfullmäktige", "kommun.se", "lokalt"],
    "region": ["landsting", "regionen", "läns", "regionalt", "district"], "myndighet": ["authority", "statlig", "offentlig", "agency"],
    "lag": ["lag", "lagstiftning", "legislation", "rättsligt"], "arbetstillstand": ["arbetstillståndet", "work permit", "residence"],
    "visum": ["visa", "entry", "inresetillstånd"], "pasport": ["passport", "pass", "identification"],
    "sjukhus": ["hospital", "klinik", "medicin", "sjukvård", "healthcare"], "läkare": ["doktor", "doctor", "physician", "medicin", "lare"],
    "sjukdom": ["sjukdomar", "illness", "disease", "hälsa", "sickness"], "symptom": ["symptoms", "tecken", "disease", "illness"],
    "medicin": ["mediciner", "läkemedel", "medicine", "drug", "apotek"], "apotek": ["pharmacy", "apoteket", "medicin", "medicines"],
    "vaccination": ["vaccin", "vaccine", "immunisering", "skyddsinjection"], "tandvard": ["tandläkare", "dental", "teeth", "oral"],
    "1177": ["health information", "vårdguide", "healthinfo"], "skola": ["school", "utbildning", "studies", "lärande", "education"],
    "universitet": ["university", "högskola", "college", "campus"], "studera": ["studies", "utbildning", "kurs", "course", "education"],
    "antagning": ["admission", "antagningsprocess", "apply", "enrollment"], "stipendium": ["scholarship", "grant", "economic support", "bidrag"],
    "examen": ["degree", "diploma", "avslutning", "graduation"], "arbete": ["jobb", "job", "work", "employment", "sysselsättning"],
    "anställning": ["anställd", "employment", "job", "position"], "löneökning": ["salary increase", "wage", "lön", "raise"],
    "arbetslös": ["unemployment", "jobless", "utan arbete", "lediga"], "cv": ["resume", "curriculum vitae", "livsöversikt"],
    "jobbsökning": ["job search", "lediga jobb", "vacancy"], "kollektivavtal": ["collective agreement", "avtal", "contract"],
    "tag": ["train", "jarnvag", "railways", "sj", "transport"], "buss": ["bus", "bussar", "public transport", "kollektivtrafik"],
    "bil": ["car", "automobile", "vehicle", "motor"], "taxi": ["cab", "transportation", "ride"], "cykel": ["bicycle", "bike", "cycling"],
    "parkering": ["parking", "park", "vehicle"], "vag": ["road", "street", "motorway", "highway"], "stad": ["city", "town", "centre", "centrum", "stadsdelar"],
    "stockholm": ["sthlm", "huvudstad", "capital", "town"], "göteborg": ["gothenburg", "gbg", "västra", "west"], "malmö": ["city", "south", "skåne", "southern"],
    "uppsala": ["town", "university", "north"], "norge": ["norway", "norsk", "scandinavian"], "danmark": ["denmark", "dansk", "scandinavian"],
    "finland": ["finland", "finnish", "nordisk"], "öppettider": ["opening hours", "öppet", "stängt", "timmar", "hours"],
    "adress": ["address", "plats", "lokalisering", "location"], "telefon": ["phone", "nummer", "ring", "call", "contact"],
    "mail": ["email", "mail", "epost", "message"], "hemsida": ["website", "web", "homepage", "internet"], "kostnad": ["price", "kostnad", "avgift", "fee", "pris"],
    "gratis": ["free", "kostnadsfritt", "no charge"], "idag": ["today", "denna dag", "aktuell"], "imorgon": ["tomorrow", "nästa dag"],
    "igår": ["yesterday", "föregående dag"], "vecka": ["week", "veckan", "weekly"], "månad": ["month", "monthly", "månad"], "år": ["year", "annual", "årlig"],
    "senaste": ["latest", "recent", "nyligen", "senast"], "kommande": ["upcoming", "nästa", "future", "framtida"],
}
STARTERS = [
    "hur kan jag ", "hur gör jag ", "hur skulle jag ", "hur kan man ", "hur gör man ", "hur blir ", "hur är det med ", "hur ansöker ",
    "vad är ", "vad betyder ", "vad kravs ", "vad gör ", "vilken är ", "vilka är ", "var ligger ", "var kan jag ", "var hittar jag ", "var ansöker ",
    "var är ", "var finns ", "när öppnar ", "när stänger ", "när är ", "när börjar ", "vilken tid öppnar ", "vilken tid stänger ", "kan jag ", "kan man ",
    "varför ", "varför är ",
]

# Kinds of questions. The last that matches wins.
QUESTION_TYPES = {
    "WHAT": ["vad", "vilken", "vilket", "vilka"], "WHO": ["vem", "vilka", "vems"], "WHERE": ["var", "vart", "varifrån"], "WHEN": ["när", "vilken tid"],
    "WHY": ["varför", "hur kommer det sig"], "HOW": ["hur", "på vilket sätt"], "HOW_MANY": ["hur många", "hur mycket"],
}
QUESTION_INTENTS = {
    "OFFICIAL": ["ansöka", "ansökan", "tillstånd", "myndighet", "riksdag", "lag"], "NEWS": ["nyhet", "aktuellt", "senaste", "idag", "igår"],
    "GUIDE": ["hur man", "guide", "instruktion", "steg för steg"], "DEFINITION": ["vad är", "vad betyder", "definition", "förklaring"],
    "COMPARISON": ["skillnad mellan", "jämförelse", "kontra", "vs"], "LOCAL": ["närmaste", "i närheten", "lokalt", "här"],
}

# The intent detector's whole words and phrases, in order; then places, then official words.
INTENT_PHRASES = {
    "guide": ["hur", "på vilka sätt", "steg för steg", "instruktion", "vägledning", "process", "procedur", "tutorial"],
    "definition": ["vad är", "vad betyder", "normal definition", "skillnad mellan", "förklaring"],
    "practical_info": ["öppettid", "adress", "telefon", "kontakt", "pris", "kostnad", "karta", "plats", "lokalisering", "timmar", "schema"],
    "news": ["senaste nytt", "idag", "nyhet", "nyheter", "nyligen", "aknyheter", "händelse", "event", "nyhetsflöde"],
}
INTENT_PLACES = ["stockholm", "göteborg", "malmö", "uppsala", "västerås", "örebro", "linköping", "helsingborg", "borås", "växjö", "sverige", "kommun", "lan", "län"]
INTENT_OFFICIAL = ["regeringen", "riksdag", "myndighet", "lag", "förordning", ".gov.se", "kommun", "stat", "statsminister", "minister"]
INTENT_BOOSTS = {
    "guide": {"freshness": 1.0, "authority": 1.5, "content_length": 2.0}, "definition": {"freshness": 1.0, "authority": 2.0, "content_length": 1.5},
    "practical_info": {"freshness": 2.5, "authority": 1.5, "content_length": 0.5, "structure": 2.0},
    "news": {"freshness": 5.0, "authority": 1.0, "content_length": 1.0, "pubdate": 10.0}, "local": {"freshness": 2.0, "location": 10.0, "authority": 1.5},
    "information": {"freshness": 1.0, "authority": 1.5, "content_length": 1.0},
}

# Places. City to county, in order.
COUNTIES = [
    "stockholm", "uppsala", "södermanland", "östergötland", "jönköping", "kronoberg", "kalmar", "gotland", "blekinge", "skåne", "halland", "västra götaland",
    "värmland", "örebro", "västmanland", "dalarna", "gävleborg", "västernorrland", "jämtland", "västerbotten", "norrbotten",
]
CITIES = {
    "stockholm": "stockholm", "huddinge": "stockholm", "sollentuna": "stockholm", "järfälla": "stockholm", "solna": "stockholm", "nacka": "stockholm",
    "göteborg": "västra götaland", "mölndal": "västra götaland", "partille": "västra götaland", "borås": "västra götaland", "malmö": "skåne", "lund": "skåne",
    "helsingborg": "skåne", "kristianstad": "skåne", "uppsala": "uppsala", "västerås": "västmanland", "örebro": "örebro", "linköping": "östergötland",
    "norrköping": "östergötland", "jönköping": "jönköping", "umeå": "västerbotten", "luleå": "norrbotten", "gävle": "gävleborg", "eskilstuna": "södermanland",
    "sundsvall": "västernorrland", "karlstad": "värmland", "växjö": "kronoberg", "halmstad": "halland",
}

# Semantic context of queries.
SCOPE_COUNTIES = {
    "stockholms": "Stockholm", "uppsala": "Uppsala", "västra götaland": "Västra Götaland", "dalarna": "Dalarna", "gävleborg": "Gävleborg",
    "västernorrland": "Västernorrland", "jämtland": "Jämtland", "västmanland": "Västmanland", "örebro": "Örebro", "sörmland": "Södermanland",
    "östergötland": "Östergötland", "småland": "Småland", "kalmar": "Kalmar", "gotland": "Gotland", "blekinge": "Blekinge", "scania": "Skåne",
    "halland": "Halland", "värmland": "Värmland", "skåne": "Skåne", "norrbotten": "Norrbotten", "västerbotten": "Västerbotten",
}
SCOPE_CITIES = {
    "stockholm": "Stockholm", "göteborg": "Västra Götaland", "malmö": "Skåne", "uppsala": "Uppsala", "västerås": "Västmanland", "örebro": "Örebro",
    "linköping": "Östergötland", "helsingborg": "Skåne", "borås": "Västra Götaland", "växjö": "Småland", "sundsvall": "Västernorrland", "umeå": "Västerbotten",
    "luleå": "Norrbotten", "falun": "Dalarna", "gävle": "Gävleborg",
}
AGENCIES = "migrationsverket skatteverket försäkringskassan arbetsförmedlingen riksdagen regeringen domstolverket csn folkhälsomyndigheten trafikverket systembolaget".split()
OFFICIAL_WORDS = ["ansöka", "tillstånd", "myndighet", "lag", "förordning", "regeringen", "riksdag"]
HOLIDAYS = ["midsommarafton", "midsommardagen", "lucia", "påsk", "marta påskdagen", "långfredagen", "annandag påsk", "valborgsmässoafton", "första maj", "jul", "nyår", "epifania"]
FRESHNESS = {"idag": (1, 3.0), "igår": (1, 2.5), "senaste": (7, 3.0), "nyligen": (7, 2.5), "denna vecka": (7, 2.0), "denna månad": (30, 1.5), "detta år": (365, 1.2)}
INTENT_MULTIPLIERS = {"OFFICIAL": 2.0, "GUIDE": 1.8, "PRACTICAL_INFO": 1.5, "NEWS": 2.5, "DEFINITION": 1.4, "LOCAL": 2.0, "GENERAL": 1.0}
LENGTH_FACTORS = {"GUIDE": 2.0, "DEFINITION": 1.5, "PRACTICAL_INFO": 0.5, "NEWS": 1.0, "OFFICIAL": 1.8, "LOCAL": 0.7, "GENERAL": 1.0}
CATEGORY_BOOSTS = {"OFFICIAL": 2.0, "GUIDE": 1.8, "NEWS": 2.5, "DEFINITION": 1.5, "PRACTICAL_INFO": 1.8, "LOCAL": 2.0}
ANSWER_PREFERENCES = {
    "DEFINITION": ("moderate", "official", 0.1, 0.9), "GUIDE": ("long", "any", 0.2, 0.7), "NEWS": ("short", "media", 0.9, 0.1),
    "PRACTICAL_INFO": ("short", "any", 0.8, 0.2), "OFFICIAL": ("any", "official", 0.3, 0.9),
}
MONTHS = {"januari": 1, "jan": 1, "februari": 2, "feb": 2, "mars": 3, "mar": 3, "april": 4, "apr": 4, "maj": 5, "juni": 6, "jun": 6, "juli": 7, "jul": 7, "augusti": 8, "aug": 8, "september": 9, "sep": 9, "oktober": 10, "okt": 10, "november": 11, "nov": 11, "december": 12, "dec": 12}
WEEKDAYS = {"måndag": "Monday", "tisdag": "Tuesday", "onsdag": "Wednesday", "torsdag": "Thursday", "fredag": "Friday", "lördag": "Saturday", "söndag": "Sunday"}

# Answers. Patterns by kind, in order, with the confidence.
ANSWER_KINDS = [
    ("COMPARISON", 0.9, r"skillnad(?:en)? mellan|jämför|[\p{L}\p{N}_]+ vs [\p{L}\p{N}_]+|[\p{L}\p{N}_]+ eller [\p{L}\p{N}_]+"),
    ("PROCEDURE", 0.85, r"hur (?:gör man|ansöker|fungerar|går det till)|hur man|steg för steg|guide för"),
    ("DEFINITION", 0.85, r"vad (?:är|innebär|betyder|menas med)|definition av|förklara"),
    ("LOCATION", 0.8, r"var (?:finns|ligger|är|kan man hitta)|plats för|adress till"),
    ("TIME", 0.8, r"när (?:öppnar|stänger|börjar|slutar)|öppettider|vilken tid|datum för"),
]
VERIFIED = [".gov.se", "riksdagen.se", "regeringen.se", "migrationsverket.se", "skatteverket.se", "forsakringskassan.se", "arbetsformedlingen.se", ".edu.se", ".su.se", ".uu.se", ".lu.se", "svt.se", "sr.se"]
AGENCY_NAMES = {
    "riksdagen.se": "Sveriges Riksdag", "regeringen.se": "Sveriges Regering", "migrationsverket.se": "Migrationsverket", "skatteverket.se": "Skatteverket",
    "forsakringskassan.se": "Försäkringskassan", "arbetsformedlingen.se": "Arbetsförmedlingen",
}

# Query variants of the encyclopedia search.
VARIANT_STARTERS = ["vad är", "vem är", "var ligger", "när grundades", "hur fungerar", "varför", "beskriv", "förklara", "vad betyder"]
ARTICLES = ["en", "ett", "den", "det", "de"]
DEFINITE_SUFFIXES = ["en", "et", "n", "t", "a", "na", "orna", "erna", "arna"]
COMPOUND_HINTS = ["historia", "stad", "landet", "kung"]

# Histogram bounds.
HTTP_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
SEARCH_BUCKETS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0]
CRAWL_BUCKETS = [1, 5, 10, 30, 60, 120, 300, 600]

# Patterns by which answers are drawn from texts.
ASKED_DEFINITION = r"vad (?:är|innebär|betyder) (.+?)(?:\?|$)"
STEP = r"(\d+)\.\s+([^\n]{10,200})"
ASKED_COMPARISON = r"skillnad(?:en)? mellan (.+?) och (.+?)(?:\?|$)"
DEFINITION_VERBS = ("är", "innebär", "betyder")

# Patterns and words of intents, official addresses and reformulations.
OFFICIAL_PATTERN = r"(?:ansöka|tillstånd|myndighet|lag)($|[^\p{L}\p{N}_])"
GUIDE_PATTERN = r"(?U)\bhur\b.*(?:ansöka|göra|får|kan)|steg för steg|instruktion"
NEWS_PATTERN = "senaste|idag|igår|nyhet|aktuellt"
DEFINITION_PATTERN = r"(^|[^\p{L}\p{N}_])vad.*(?:är|betyder)|skillnad mellan|förklaring"
PRACTICAL_PATTERN = "öppettid|adress|telefon|pris|timmar|schema"
OFFICIAL_URLS = [".gov.se", "migrationsverket", "skatteverket", "riksdagen", "regeringen"]
PAIR_PATTERN = r"mellan\s+(.+?)\s+(?:och|eller)\s+(.+?)(?:\?|$)"
REFORMULATED_HOURS = ["öppet", "timmar", "hours", "klocka"]
REFORMULATED_ADDRESS = ["address", "plats", "väg", "street"]
REFORMULATED_PHONE = ["phone", "ring", "call"]

# Patterns of the places that a query names, of domains, and the words that an intent's query does without (None: its marks), in order.
PLACE_PATTERNS = [r"i ([\p{L}\p{N}_\s]+?)(?:\s|$|,|\.)", r"från ([\p{L}\p{N}_\s]+?)(?:\s|$|,|\.)", r"([\p{L}\p{N}_\s]+?) kommun", r"([\p{L}\p{N}_\s]+?) län"]
VALID_DOMAIN = r"^[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}$"
INTENT_REMOVED = ["(?:hur|vad|vilken|var|när)", None, "ärvid", "är", "man", "skillnaden mellan"]

# Colours of alerts by severity.
ALERT_COLOURS = {"info": "#36a64f", "warning": "#ff9900", "error": "#ff0000", "critical": "#990000"}

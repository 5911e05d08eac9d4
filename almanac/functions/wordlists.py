"""Word lists of the question router.

Fixed values: every list below must hold exactly these texts in this order,
because routing results depend on them.
"""

# Country names in questions -> names in the location dimension.
COUNTRY_ALIASES = {
    "portugal": "Portugal", "espanha": "Spain",
    "alemanha": "Germany", "frança": "France", "franca": "France",
    "itália": "Italy", "italia": "Italy",
    "reino unido": "United Kingdom",
    "estados unidos": "United States",
    "holanda": "Netherlands", "países baixos": "Netherlands",
    "bélgica": "Belgium", "belgica": "Belgium",
    "suécia": "Sweden", "suecia": "Sweden",
    "noruega": "Norway", "dinamarca": "Denmark",
    "finlândia": "Finland", "finlandia": "Finland",
    "áustria": "Austria", "austria": "Austria",
    "suíça": "Switzerland", "suica": "Switzerland",
    "irlanda": "Ireland", "islândia": "Iceland", "islandia": "Iceland",
    "luxemburgo": "Luxembourg", "malta": "Malta", "chipre": "Cyprus",
    "polónia": "Poland", "polonia": "Poland",
    "hungria": "Hungary",
    "república checa": "Czech Republic", "chéquia": "Czech Republic", "chequia": "Czech Republic",
    "eslováquia": "Slovakia", "eslovaquia": "Slovakia",
    "eslovénia": "Slovenia", "eslovenia": "Slovenia",
    "croácia": "Croatia", "croacia": "Croatia",
    "bulgária": "Bulgaria", "bulgaria": "Bulgaria",
    "roménia": "Romania", "romania": "Romania",
    "estónia": "Estonia", "estonia": "Estonia",
    "letónia": "Latvia", "letonia": "Latvia",
    "lituânia": "Lithuania", "lituania": "Lithuania",
    "grécia": "Greece", "grecia": "Greece",
    "albânia": "Albania", "albania": "Albania",
    "sérvia": "Serbia", "serbia": "Serbia",
    "bósnia": "Bosnia and Herzegovina", "bosnia": "Bosnia and Herzegovina",
    "macedónia": "North Macedonia", "macedonia": "North Macedonia",
    "montenegro": "Montenegro", "kosovo": "Kosovo",
    "rússia": "Russia", "russia": "Russia",
    "ucrânia": "Ukraine", "ucrania": "Ukraine",
    "bielorrússia": "Belarus", "bielorrussia": "Belarus",
    "moldova": "Moldova", "moldávia": "Moldova", "moldavia": "Moldova",
    "arménia": "Armenia", "armenia": "Armenia",
    "geórgia": "Georgia", "georgia": "Georgia",
    "azerbaijão": "Azerbaijan", "azerbaijao": "Azerbaijan",
    "cazaquistão": "Kazakhstan", "cazaquistao": "Kazakhstan",
    "turquia": "Turkey",
    "índia": "India", "india": "India",
    "china": "China", "japão": "Japan", "japao": "Japan",
    "coreia do sul": "Korea, Republic of",
    "argélia": "Algeria", "algeria": "Algeria",
    "egipto": "Egypt", "egito": "Egypt",
    "marrocos": "Morocco", "moçambique": "Mozambique", "mocambique": "Mozambique",
    "áfrica do sul": "South Africa", "africa do sul": "South Africa",
    "nigéria": "Nigeria", "nigeria": "Nigeria",
    "etiópia": "Ethiopia", "etiopia": "Ethiopia",
    "brasil": "Brazil", "mexico": "Mexico", "méxico": "Mexico",
    "argentina": "Argentina", "canadá": "Canada", "canada": "Canada",
    "colombia": "Colombia", "colômbia": "Colombia",
    "chile": "Chile", "peru": "Peru", "venezuela": "Venezuela",
    "austrália": "Australia", "australia": "Australia",
    "nova zelândia": "New Zealand", "nova zelandia": "New Zealand",
}

META_SIGNALS = [
    (r"\bquantos (registos|registros|dados|valores)\b", "count_records"),
    (r"\bquantos países\b", "count_countries"),
    (r"\bquantos indicadores\b", "count_indicators"),
    (r"\bquantos relatórios\b", "count_reports"),
    (r"\b(que|quais( os?)?) países\b", "list_countries"),
    (r"\b(lista[r]? |que |quais( os?)? )indicadores\b", "list_indicators"),
    (r"\bdados disponíveis\b", "count_records"),
]

COMPARISON_SIGNALS = [
    r"\bacima ou abaixo\b",
    r"\bsuperior ou inferior\b",
    r"\bmais alto ou mais baixo\b",
    r"\bmais elevado ou mais baixo\b",
]

EXISTENCE_SIGNALS = [
    r"\btem dados\b",
    r"\bexiste[m]?\b",
    r"\bhá dados\b",
    r"\bcontém\b",
    r"\bcontem\b",
]

COMPLEX_SIGNALS = [
    r"\be\s+\w{3,}", r"\bou\s+(?!acima|abaixo)\w{3,}", r"\bvs\.?\b", r"\bversus\b", r"\bcompar",
    r"\bmedia\b", r"\bmédia\b", r"\bmédio\b", r"\bsoma\b",
    r"\bmáximo\b", r"\bmaximo\b", r"\bmínimo\b", r"\bminimo\b",
    r"\bmaior\s+valor\b", r"\bmenor\s+valor\b",
    r"\bcrescimento\b", r"\bdiferença\b", r"\bdiferenca\b", r"\bvariação\b",
    r"\bde \d{4} a \d{4}\b", r"\bentre \d{4} e \d{4}\b", r"\banos \d{4}",
    r"\btop\s*\d+\b", r"\bmelhores\b", r"\bpiores\b", r"\bpior\b",
    r"\bverifica\b", r"\bé maior\b", r"\bé menor\b", r"\bsuperior\b", r"\binferior\b",
    r"\bacima de\b", r"\babaixo de\b",
    r"\bevolução\b", r"\bevolucao\b", r"\bhistórico\b", r"\bhistorico\b",
    r"\bao longo\b", r"\btendência\b",
    r"\w+,\s*\w+\s+e\s+\w+",
    r"\búltimos\s*\d+\b", r"\batual\b", r"\bactual\b", r"\bmais recente\b",
    r"\bem que ano\b", r"\bque ano\b", r"\bano\s+em\s+que\b",
    r"\bpara quais\b", r"\bquais os\b", r"\btodos os\b",
]

RANKING_WORDS = [
    "lugar", "posição", "posicao", "ranking", "rank", "classificação", "classificacao",
    "maior valor", "menor valor", "mais alto", "mais baixo",
    "país com maior", "país com menor", "nação com maior", "nação com menor",
    "acima", "abaixo", "acima ou abaixo", "melhor", "pior",
]

YEAR = r"\b(?:19|20)\d{2}\b"
TOP_N = r"\btop\s*(\d+)\b"
WORST_WORDS = r"\bpiores?\b|\bmenor\b|\binferior\b|\babaixo\b"
CONTEXT_PREFIX = r'Contexto anterior:.*"\.\s+'
SAME_INDICATOR = (
    r"\b(mesmo indicador|para o mesmo|neste indicador|no mesmo|o mesmo indicador"
    r"|este indicador|nesse indicador|deste indicador|indicador anterior"
    r"|esse indicador|essa indicador|aquele indicador|aquela indicador"
    r"|para esse indicador|para este indicador|nesse mesmo|neste mesmo)\b"
)

VALUE_SENTENCES = [
    "Em {year}, {country} registou um valor de {value} para {indicator}.",
    "{country} apresentou {value} em {indicator} no ano de {year}.",
    "O valor de {indicator} para {country} em {year} foi de {value}.",
]
RANKING_SENTENCES = [
    "{country} ficou na {ranking}.ª posição no ranking de {indicator} em {year}, com {value}.",
    "Em {year}, {country} ocupou o {ranking}.º lugar em {indicator} (valor: {value}).",
]
EXISTENCE_SENTENCES = [
    "Foram encontrados {count} registo(s) de {indicator} para {country} em {year}.",
    "A base de dados contém {count} entrada(s) de {indicator} para {country} no ano {year}.",
]
NOTHING_SENTENCES = [
    "Não foram encontrados dados para esta consulta.",
    "Sem resultados para os parâmetros indicados.",
]

"""Word lists, tables and patterns that results depend on. All are defaults of parameters."""

#: Characters of a word in the archive's alphabet, with the marks that may stand inside a word.
ARCHIVE_WORD = "[Ա-և]+"
#: Characters of a word in any alphabet.
ANY_WORD = "\\p{L}+"
#: Case endings that a name may carry.
NAME_SUFFIXES = ("", "ին", "ի", "ից", "ով", "ում", "ը", "ն", "ներ", "ների", "ներին")
#: Words without topical content.
STOP_WORDS = "ու և որ ա ես դու էս էն ինչ չի մի էլ ոնց հա բա դա ինձ քեզ նա մեր ձեր իր այ դե եմ ենք են եք ին ից ում էր հետ դուք մենք համար".split()
#: Places that are facets; any other is the last value.
PLACES = ("Տուն", "Դուրս", "Խանութ", "Հիվանդանոց", "Գրասենյակ", "Փողոց", "Մեքենա")
OTHER_PLACE = "Այլ"
#: Known cast, and misspellings of it.
CAST = ("Հայկո Մկո Հասմիկ Լևոն Անդո Քրիստինե Աշոտ Արմինե Ռաֆո Արմեն Սմբո Մարի Հայո Սիմոնյան Հովո Սամվել Սամ Գեղամ Վաղո Պետրոսյան Վարդան Սաքո Մամիկոն Գագո Վաչո Ստյոպ Գուգո").split()
MISSPELT = {"Հակյո": "Հայկո", "ՄԿո": "Մկո"}
#: Transliteration: digraphs first, then single letters.
LATIN = (
    {"ու": "u", "և": "ev"},
    {
        "ա": "a", "բ": "b", "գ": "g", "դ": "d", "ե": "e", "զ": "z", "է": "e", "ը": "", "թ": "t", "ժ": "zh", "ի": "i", "լ": "l", "խ": "kh",
        "ծ": "ts", "կ": "k", "հ": "h", "ձ": "dz", "ղ": "gh", "ճ": "ch", "մ": "m", "յ": "y", "ն": "n", "շ": "sh", "ո": "o", "չ": "ch", "պ": "p",
        "ջ": "j", "ռ": "r", "ս": "s", "վ": "v", "տ": "t", "ր": "r", "ց": "ts", "ւ": "v", "փ": "p", "ք": "k", "օ": "o", "ֆ": "f",
    },
)
CYRILLIC = (
    {"ու": "у", "և": "ев"},
    {
        "ա": "а", "բ": "б", "գ": "г", "դ": "д", "ե": "е", "զ": "з", "է": "э", "ը": "", "թ": "т", "ժ": "ж", "ի": "и", "լ": "л", "խ": "х",
        "ծ": "ц", "կ": "к", "հ": "г", "ձ": "дз", "ղ": "г", "ճ": "ч", "մ": "м", "յ": "й", "ն": "н", "շ": "ш", "ո": "о", "չ": "ч", "պ": "п",
        "ջ": "дж", "ռ": "р", "ս": "с", "վ": "в", "տ": "т", "ր": "р", "ց": "ц", "ւ": "в", "փ": "п", "ք": "к", "օ": "о", "ֆ": "ф",
    },
)
#: Search fields with their weights.
FIELD_WEIGHTS = {"textCommon": 5, "title": 4, "text": 3, "actorsRaw": 2, "rolesNames": 1, "location": 1}
#: Prices of a million tokens in and out, in dollars, by model.
TOKEN_PRICES = {"lite": (0.50, 1.5), "pro": (2.0, 12.0)}
#: Hours of audio that costs are carried on to.
ARCHIVE_HOURS = 33.6
#: Kinds of usage events.
EVENT_TYPES = ("search", "open", "filter", "findname", "copy")
#: The lead pair, and names that mentions are suggested of.
LEADS = ("Հայկո", "Մկո")
CANDIDATES = ("Անի", "Արմեն", "Վարդան", "Գագ", "Սաքո", "Գագո", "Համո", "Գևորգ", "Սուրեն")

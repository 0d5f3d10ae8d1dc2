"""Word lists for generated values. All are made up from common words and names of no one in particular."""

FIRST = (
    "Ada Alan Alice Amir Andrea Anna Arthur Asha Bella Boris Bruno Carla Cecil Chloe Clara Daniel Daria David Elena Elias Emma Erik Esther Eva Felix Fiona Frank Gabriel "
    "Grace Hanna Hugo Ida Igor Ines Iris Ivan Jan Jasmin Joan Jonas Julia Karim Kira Lara Laura Leo Lina Louis Lucia Marc Maria Martin Maya Mila Nadia Nico Nina Noah Nora "
    "Olga Oscar Otto Pablo Paula Peter Petra Rafael Rita Robin Rosa Ruth Samir Sara Simon Sofia Stella Tara Theo Thomas Tina Ursula Vera Victor Vincent Walter Wanda Yara Zoe"
).split()
LAST = (
    "Abbott Adler Alder Archer Ashford Baker Barnes Bauer Becker Bell Berg Bishop Blake Bond Brandt Brook Burns Carver Castle Chandler Clark Cole Cooper Crane Croft Cross Dale "
    "Dalton Decker Drake Dunn Ellis Falk Farmer Fields Finch Fisher Fletcher Ford Forest Foster Fowler Frost Gardner Glover Grant Gray Greene Griffin Hale Hansen Harper Hart "
    "Hayes Hill Holm Hunter Jensen Keller Knight Kramer Lake Lambert Lane Lang Larsen Mason Mercer Miller Moore Morris Nash North Norton Olsen Page Palmer Parker Perry Porter "
    "Potter Reed Rhodes Rivers Roth Sawyer Shaw Sharp Shepherd Steele Stone Sutton Tanner Taylor Thorne Turner Vale Vogel Wagner Walker Ward Waters Weaver Webb Wells West Wood York"
).split()
CITY = ("Ash Birch Bridge Brook Cedar Clear Clover East Elm Fair Fox Glen Green Haven High Lake Maple Mill New North Oak Pine Red River Rock Rose Silver South Spring Stone West Wind").split()
CITY_END = ("bury dale field ford gate ham mouth port ridge side ton view ville wick wood worth").split()
STREET = ("Acorn Alder Aspen Beech Bell Canal Cedar Chapel Cherry Church Elm Forest Garden Grove Harbour Hazel Hill King Lake Laurel Lily Main Maple Meadow Mill Oak Orchard Park Pine Pond Poplar Queen River Rose Spring Station Sunset Valley Walnut Willow").split()
STREET_END = ("Street Avenue Road Lane Drive Court Way Place Crescent").split()
MAIL = ("mail.example.com", "post.example.org", "inbox.example.net", "letters.example.com", "web.example.org")
WORDS = (
    "able account action after again agree allow almost along always amount answer appear apply area around arrive autumn balance basic because become before begin behind better "
    "between board bring build carry centre certain change choice clear close common complete consider continue control corner country course cover create current decide deep "
    "design different direct discuss early effect either energy enough entire example expect explain family field final follow force formal forward friend future garden general "
    "ground group happen heavy history house however human idea important improve include indeed inside interest journey keep large later learn leave letter level light likely "
    "local machine manage market matter member method middle minute modern moment money morning mountain music nature night notice number offer office often open order other paper "
    "particular people perhaps period place point possible power present problem process produce public question quick quite reason record remember report result river"
).split()

#: Lists of other languages; what a language doesn't have is taken from English.
LANGUAGES = {
    "fr": {
        "FIRST": (
            "Adèle Agathe Alain Amélie André Antoine Arnaud Aurélie Bastien Béatrice Benoît Camille Cécile Céline Chantal Clément Colette Damien Delphine Denis Édith Élise Émile "
            "Étienne Fabien Florence Gaston Geneviève Gérard Gilles Hélène Henri Hervé Jacques Jérôme Joëlle Julien Laurence Léa Loïc Luc Lucie Manon Marcel Margaux Mathilde "
            "Maxime Noémie Océane Odette Olivier Pascal Pauline Rémi René Sabine Sébastien Solange Sylvie Théo Thierry Valérie Véronique Xavier Yann Yvette Zélie"
        ).split(),
        "LAST": (
            "Barbier Beaulieu Bellerose Bergeron Blanchet Boisvert Boucher Boulanger Carpentier Charpentier Charron Chevalier Cordier Couturier Delorme Deschamps Desjardins Dubois "
            "Dufour Dumont Dupuis Fabre Faucher Fontaine Forestier Fournier Garnier Gauthier Girard Granger Lacroix Lafontaine Lamontagne Langlois Lapierre Larivière Laroche Lavigne "
            "Lebrun Leclerc Lefort Lemaire Lemieux Letourneau Levasseur Marchand Maréchal Mercier Meunier Monet Moulin Pelletier Perrin Plourde Potier Renard Rivière Rousseau Roussel "
            "Savard Simard Tessier Tisserand Vacher Vallée Verrier"
        ).split(),
        "CITY": "Beau Belle Bois Champ Château Clair Fontaine Grand Haut Lac Mont Neuve Pont Roche Saint Val Vert Vieux".split(),
        "CITY_END": "bois bourg champ court fort lac mont pré rive roche vallon ville".split(),
        "STREET": "rue avenue boulevard chemin allée place cours impasse".split(),
        "STREET_END": "des_Acacias des_Bouleaux du_Canal des_Cèdres des_Chênes de_la_Colline des_Érables de_la_Fontaine de_la_Forêt du_Lac des_Lilas du_Moulin des_Ormes du_Parc des_Pins du_Port du_Quai des_Saules de_la_Source".split(),
    },
    "de": {
        "FIRST": (
            "Anja Annika Antje Axel Bärbel Bernd Birgit Bodo Britta Carsten Dagmar Detlef Dieter Dörte Eike Elke Enno Falk Frauke Friedrich Gerd Gisela Götz Gudrun Hannes Heike Heinz "
            "Helga Holger Ilse Ingo Jens Jörg Jürgen Jutta Käthe Kai Karin Klaus Lars Lore Lothar Maike Malte Marlies Meike Nils Norbert Ortrud Ralf Reiner Rolf Rüdiger Sabine Silke "
            "Sönke Stefan Susanne Sven Swantje Tanja Thorsten Torben Uta Uwe Volker Wiebke Wolfgang"
        ).split(),
        "LAST": (
            "Ackermann Albrecht Bäcker Baumann Beckmann Bergmann Böttcher Brandt Brückner Dietrich Drechsler Ebert Eckert Falkner Fiedler Förster Gärtner Gerber Glaser Graf Günther "
            "Hahn Hartmann Heinrich Herzog Hofmann Holzer Jäger Kästner Kaufmann Keller Kessler Köhler Krämer Krüger Kühn Lehmann Lindner Lorenz Maurer Metzger Möller Müller Naumann "
            "Pfeiffer Pohl Rademacher Richter Ritter Sattler Schäfer Schmied Schneider Schreiber Schröder Schuster Seidel Sommer Steiner Töpfer Vogt Wächter Wagner Weber Wegner Winkler "
            "Zimmermann"
        ).split(),
        "CITY": "Alt Berg Birken Buchen Eichen Erlen Grün Hirsch Hoch Kirch Linden Mittel Neu Nieder Ober Rosen Schön Stein Tannen Wald Wiesen".split(),
        "CITY_END": "ach bach berg brück burg dorf feld hausen heim hof stadt stein tal walde".split(),
        "STREET": "Ahorn Amsel Bach Bahnhof Berg Birken Blumen Buchen Burg Dorf Eichen Feld Garten Goethe Hafen Haupt Kirch Linden Markt Mühlen Rosen Schul Sonnen Tannen Wald Wiesen".split(),
        "STREET_END": "allee gasse platz ring steig straße ufer weg".split(),
    },
}


class Words:
    """The lists of a locale such as fr_CA, by its language."""

    def __init__(self, locale: str = "en"):
        self.language = (locale or "en").replace("-", "_").partition("_")[0].lower()

    def __getattr__(self, name: str) -> list[str]:
        found = LANGUAGES.get(self.__dict__["language"], {}).get(name, globals().get(name)) if name.isupper() else None
        if found is None:
            raise AttributeError(name)
        return list(found)


JOBS = (
    "accountant actor architect baker bookseller carpenter chemist civil_engineer cook dentist driver editor electrician farmer fisher florist forester gardener geologist journalist "
    "judge lawyer librarian locksmith machinist mason mechanic midwife musician nurse optician painter pharmacist photographer pilot plumber postman printer programmer roofer sailor "
    "secretary shepherd social_worker surgeon surveyor tailor teacher translator upholsterer veterinarian weaver welder writer"
).replace("_", "-").split()
COUNTRIES = {
    "AR": "Argentina", "AU": "Australia", "AT": "Austria", "BE": "Belgium", "BR": "Brazil", "CA": "Canada", "CL": "Chile", "CN": "China", "CZ": "Czechia", "DK": "Denmark",
    "EG": "Egypt", "FI": "Finland", "FR": "France", "DE": "Germany", "GH": "Ghana", "GR": "Greece", "IS": "Iceland", "IN": "India", "IE": "Ireland", "IT": "Italy", "JP": "Japan",
    "KE": "Kenya", "MX": "Mexico", "MA": "Morocco", "NL": "Netherlands", "NZ": "New Zealand", "NO": "Norway", "PE": "Peru", "PL": "Poland", "PT": "Portugal", "RO": "Romania",
    "SN": "Senegal", "ZA": "South Africa", "ES": "Spain", "SE": "Sweden", "CH": "Switzerland", "TR": "Türkiye", "GB": "United Kingdom", "US": "United States", "UY": "Uruguay", "VN": "Vietnam",
}
CURRENCIES = "ARS AUD BRL CAD CHF CLP CNY CZK DKK EGP EUR GBP GHS INR ISK JPY KES MAD MXN NOK NZD PEN PLN RON SEK TRY USD UYU VND ZAR".split()
COLOURS = "amber aqua beige black blue bronze brown copper coral cream crimson cyan gold green grey indigo ivory khaki lavender lilac lime magenta maroon mint navy ochre olive orange peach pink plum purple red rose rust sand silver teal violet white yellow".split()
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()

"""The small labelled table that the tagger of problem 8 is trained from.

Each row is a line and the places of its mentions. Rows are drawn, always the same ones, from a grammar: cues, verbs and
everyday vocabulary of English, German, French and Spanish, public formats of numbers and addresses, common names, and
as many names and words put together from syllables, so that a mention must be told by its form and its neighbours and
not only by known words. It was written down for this purpose from general knowledge, and no text of a corpus was
copied; the README says what errors on documents were looked at meanwhile.
"""

from __future__ import annotations

import random

KINDS = ("email", "phone", "id_number", "address", "person")
Mention = tuple[int, int, str]

_FIRST = """James Mary Robert Patricia Michael Jennifer William Linda David Elizabeth Richard Barbara Joseph Susan Thomas Jessica Charles Sarah Daniel Karen
Matthew Lisa Anthony Nancy Mark Betty Paul Sandra Steven Ashley Andrew Emily Kenneth Donna George Michelle Kevin Laura Brian Emma Edward Olivia Grace Owen
Hans Klaus Jürgen Wolfgang Dieter Manfred Uwe Stefan Matthias Florian Sabine Petra Monika Renate Heike Anja Katrin Ulrike Jörg Günter Björn Sören Käthe Frieda
Jean Pierre Jacques François Philippe Nicolas Étienne Gérard Luc Marie Catherine Nathalie Céline Amélie Zoé Chloé Léa Agnès Hélène Anaïs Benoît Mathilde
José Juan Carlos Javier Miguel Ángel Fernando Sergio Raúl Andrés María Carmen Isabel Pilar Lucía Sofía Marta Elena Rocío Íñigo Nuria Ximena
Giulia Marco Luca Francesca Matteo Chiara João Tiago Rui Ana Inês Lars Erik Astrid Ingrid Sven Freja Ole Aino Mikko Piotr Agnieszka Katarzyna Jakub Ivan
Olga Dmitri Natasha Yuri Mehmet Ayşe Fatma Emre Ahmed Fatima Omar Leila Hassan Amina Wei Mei Hiroshi Yuki Kenji Priya Arjun Anjali Ravi Nia Kwame Thandi""".split()
_LAST = """Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson White Harris Clark Lewis Robinson Walker Young
Allen King Wright Scott Hill Green Adams Baker Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins O'Brien O'Connor McDonald
Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Krüger Hartmann
Dubois Durand Leroy Moreau Laurent Lefebvre Roux Fournier Girard Bonnet Lambert Fontaine Rousseau Mercier Blanc Guérin Garnier Chevalier Besson Renaud
García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Díaz Torres Ruiz Navarro Iglesias Ortega Delgado Castro Ortiz Muñoz Núñez Vázquez
Rossi Ferrari Esposito Bianchi Silva Santos Ferreira Pereira Hansen Johansson Nilsson Larsen Virtanen Kowalski Nowak Novák Horvat Petrov Ivanova Yılmaz Demir
Khan Ali Hussein Haddad Chen Wang Nguyen Tanaka Suzuki Kim Park Patel Sharma Singh Okafor Mensah Dlamini""".split()
_PARTICLES = ["von", "von der", "van", "van der", "van den", "de", "de la", "del", "du", "della", "di", "da", "dos", "zu", "ten", "le", "al"]
_TITLES = ["Mr. ", "Mrs. ", "Ms. ", "Mr ", "Ms ", "Dr. ", "Dr ", "Prof. ", "Prof. Dr. ", "Herr ", "Frau ", "Herrn ", "Herr Dr. ", "M. ", "Mme ", "Mlle ", "Monsieur ", "Madame ", "Sr. ", "Sra. ", "Señor ", "Señora ", "Don ", "Doña "]
_ONSET = "b br c ch d dr f fl g gr h j k kl l m n p pr qu r s sch st t th tr v w y z".split()
_NUCLEUS = "a a e e i i o o u ai au ei ie ou é ó ü".split()
_CODA = ["", "", "", "l", "n", "r", "s", "m", "x", "nd", "rt", "ck", "ll", "ng", "st"]
_NAME_END = ["", "", "son", "sen", "mann", "er", "ez", "eau", "ini", "ov", "ski", "sky", "berg", "stein", "ström", "feld", "wood", "ley", "ton", "ard", "ier", "elli", "ic", "ides", "oğlu", "bach", "quist"]
_TOWNS = "London Leeds York Berlin Hamburg Köln Bremen Paris Lyon Lille Madrid Sevilla Bilbao Boston Denver Austin Dublin Wien Zürich Genf".split()

_WORDS = {
    "en": (
        """report index folder check table record limit branch review release test queue buffer parser summary merge note list result hash copy version change update error
 schema column threshold entry segment layout checksum draft config cache module script pipeline match sample corpus paragraph heading header footer section chapter page
 report ticket issue step stage batch job run log trace cluster pair score group duplicate archive backup storage disk server key value field list order plan goal budget meeting
 agenda question answer example rule path file line text word sentence token street road lane avenue court square park bridge garden house office desk team floor""",
        """new old small large stale fresh missing broken clean empty partial full final first last next open closed local remote shared common rare slow fast safe wrong right exact
 rough quiet early late weekly daily manual hidden shallow deep wide narrow second third several other same different stable minor major internal external""",
        """reads writes drops keeps moves checks covers needs shows holds fails passes returns opens closes skips lists counts merges sorts splits joins finds marks hides adds removes
 replaces repeats follows matches blocks delays confirms updates explains compares exceeds contains""",
        "the a this that every each no some one its our".split(),
        "in of for with after before under over behind near from to on by without against between".split(),
        "and but because while when although since if so or".split(),
    ),
    "de": (
        """Bericht Verzeichnis Ordner Prüfung Tabelle Satz Grenze Zweig Durchsicht Ausgabe Test Schlange Puffer Übersicht Hinweis Liste Ergebnis Kopie Version Änderung Fehler Spalte
 Schwelle Eintrag Abschnitt Aufbau Entwurf Stapel Lauf Protokoll Gruppe Paar Bewertung Archiv Sicherung Speicher Rechner Schlüssel Wert Feld Reihenfolge Ziel Sitzung Frage Antwort Beispiel
 Regel Pfad Datei Zeile Text Wort Übergabe Stand Woche Sprache Vergleich Quelle Anlage Vorgang Auswahl Absatz Kapitel Seite Brücke Garten Büro Straße Weg Platz Tisch Beschreibung""",
        "neue alte kleine große leere volle letzte erste offene lokale seltene langsame schnelle sichere falsche genaue grobe frühe späte tägliche ganze gleiche andere stabile innere äußere fehlende",
        "liest schreibt verwirft behält verschiebt prüft braucht zeigt hält meldet öffnet schließt überspringt zählt ordnet teilt verbindet findet ersetzt wiederholt vergleicht enthält bleibt fehlt",
        "der die das ein eine jeder jede kein keine dieser diese sein ihr den dem".split(),
        "in von für mit nach vor unter über hinter bei aus zu auf durch ohne gegen zwischen".split(),
        "und aber weil während wenn obwohl seit ob oder sobald".split(),
    ),
    "fr": (
        """rapport index dossier contrôle tableau enregistrement limite branche relecture sortie essai file tampon résumé note liste résultat copie version changement erreur colonne seuil
 entrée segment plan brouillon lot passage journal groupe paire score archive sauvegarde disque serveur clé valeur champ ordre but réunion question réponse exemple règle chemin fichier
 ligne texte mot semaine langue source annexe paragraphe chapitre page pont jardin bureau rue place étape étage équipe""",
        "nouveau ancien petit grand vide plein dernier premier ouvert fermé local rare lent rapide sûr faux exact grossier tardif quotidien entier autre même stable interne externe manquant",
        "lit écrit retire garde déplace vérifie couvre demande montre tient échoue ouvre ferme saute compte fusionne trie sépare trouve remplace répète suit compare dépasse contient reste",
        "le la les un une ce cette chaque aucun aucune son sa leur".split(),
        "dans de pour avec après avant sous sur derrière près chez par sans contre entre".split(),
        "et mais car pendant quand comme si ou donc puisque".split(),
    ),
    "es": (
        """informe índice carpeta control tabla registro límite rama revisión entrega prueba cola resumen nota lista resultado copia versión cambio error columna umbral entrada segmento plan
 borrador lote paso diario grupo par puntuación archivo respaldo disco servidor clave valor campo orden objetivo reunión pregunta respuesta ejemplo regla ruta fichero línea texto palabra
 semana idioma fuente anexo párrafo capítulo página puente jardín oficina calle plaza etapa equipo""",
        "nuevo viejo pequeño grande vacío lleno último primero abierto cerrado local raro lento rápido seguro falso exacto tosco tardío diario entero otro mismo estable interno externo ausente",
        "lee escribe quita guarda mueve revisa cubre necesita muestra falla abre cierra salta cuenta une ordena separa encuentra reemplaza repite sigue compara supera contiene queda devuelve",
        "el la los un una este esta cada ningún ninguna su".split(),
        "en de para con tras antes bajo sobre detrás cerca por sin contra entre según".split(),
        "y pero porque mientras cuando aunque si o pues".split(),
    ),
}
_COPULAS = {"en": "is was stays seems becomes remains looks".split(), "de": "ist war wird bleibt scheint wirkt".split(), "fr": "est était reste semble devient".split(), "es": "es está era queda parece sigue".split()}
_DEGREES = {"en": ["", "", "very ", "too ", "quite ", "almost ", "still "], "de": ["", "", "sehr ", "zu ", "fast ", "noch ", "etwas ", "meist "], "fr": ["", "", "très ", "trop ", "presque ", "encore "], "es": ["", "", "muy ", "demasiado ", "casi ", "todavía "]}
_NOUN_ENDS = "ung ung heit keit nis schaft er e el ion tät ment ar ling tum".split()
_WHEN = {
    "en": "yesterday|today|last week|on Monday|on Friday|this morning|again|twice|in March|earlier|before lunch|at noon|over the weekend".split("|"),
    "de": "gestern|heute|letzte Woche|am Montag|am Freitag|heute früh|wieder|zweimal|im März|vorher|mittags|am Wochenende".split("|"),
    "fr": "hier|aujourd'hui|la semaine dernière|lundi|vendredi|ce matin|encore|deux fois|en mars|avant midi|ce week-end".split("|"),
    "es": "ayer|hoy|la semana pasada|el lunes|el viernes|esta mañana|otra vez|dos veces|en marzo|antes de comer|anoche".split("|"),
}
_VERBLAST = "fragen anrufen informieren bitten einladen vertreten erreichen schreiben grüßen kontaktieren ansprechen sprechen klären abstimmen übergeben schicken".split()
_PASSIVE = "reviewed checked written changed sent signed merged approved moved drafted closed opened tested read fixed noted dropped updated prepared seen".split()
_WORDS = {k: tuple(w.split() if isinstance(w, str) else w for w in v) for k, v in _WORDS.items()}

#: What stands before a person, by language; ~ for what may follow: any prose.
_BEFORE = {
    "en": """ask|please ask|talk to|spoke to|speak with|call|contact|met|met with|according to|thanks to|thank you|handed to|passed to|given to|sent to|sent by|written by|reviewed by|checked by|approved by|signed by|signed|
 owned by|owner|assigned to|reported by|raised by|requested by|changed by|last touched by|drafted by|waiting for|on behalf of|replaces|joined by|together with|and|cc|from|per|for|by|to|with|via|attn|attention|
 hi|hello|dear|regards|best regards|kind regards|cheers|thanks|yours|said|note from|message from|reminder from|mail from|feedback from|question from|contact person is|contact is|author is|the author,|our colleague|the reviewer,|the reviewer""",
    "de": """bitte|frag|fragt|fragen Sie|gesprochen mit|Rücksprache mit|Gespräch mit|laut|nach|dank|Dank an|danke|danke an|übergeben an|weiter an|geschickt von|geschrieben von|geprüft von|gesehen von|freigegeben von|unterschrieben von|gez.|
 verantwortlich|zuständig ist|zuständig|gemeldet von|angefragt von|geändert von|zusammen mit|und|von|an|bei|für|durch|mit|statt|Vertretung|hallo|guten Tag|liebe|lieber|sehr geehrte|sehr geehrter|Grüße|viele Grüße|beste Grüße|Gruß|
 Ansprechpartner ist|Ansprechpartnerin ist|Autor ist|unser Kollege|unsere Kollegin|Nachricht von|Hinweis von|Rückfrage an|Anruf von""",
    "fr": """demandez à|demander à|voir avec|parlé à|parlé avec|appelez|contactez|rencontré|selon|d'après|grâce à|merci à|merci|transmis à|confié à|envoyé par|envoyé à|écrit par|relu par|vu par|vérifié par|validé par|signé par|signé|
 responsable|attribué à|signalé par|demandé par|modifié par|en attente de|au nom de|avec|et|de|par|à|pour|chez|via|bonjour|cher|chère|cordialement|bien à vous|salutations|l'auteur est|le contact est|notre collègue|message de|note de|question de|rappel de""",
    "es": """pregunte a|preguntar a|hable con|hablado con|hablamos con|llame a|contacte con|reunión con|según|gracias a|gracias|entregado a|pasado a|enviado por|enviado a|escrito por|revisado por|visto por|comprobado por|aprobado por|firmado por|firmado|
 responsable|asignado a|avisado por|pedido por|cambiado por|a la espera de|en nombre de|junto con|con|y|de|por|a|para|vía|hola|estimado|estimada|un saludo|saludos|atentamente|el autor es|el contacto es|nuestro colega|mensaje de|nota de|pregunta de|recordatorio de""",
}
#: What stands after a person that begins the sentence.
_AFTER = {
    "en": """said|says|wrote|writes|asked|thinks|found|agreed|replied|reported|noted|confirmed|added|answered|suggested|wants|will|has|had|is|was|can|takes over|took over|owns|reviewed|checked|signed|approved|moved|left|joined|called|
 is out|is back|looks after|no longer|and I|and the others|who|also|still""",
    "de": "sagt|sagte|schrieb|schreibt|fragt|meint|fand|findet|antwortete|meldete|bestätigte|will|wird|hat|hatte|ist|war|kann|übernimmt|übernahm|prüft|prüfte|sah|unterschrieb|ging|kam|rief an|betreut|kümmert sich|bittet|und ich|auch|noch",
    "fr": "dit|a dit|écrit|a écrit|demande|a demandé|pense|trouve|a répondu|a signalé|a confirmé|veut|va|a|avait|est|était|peut|reprend|a repris|relit|a relu|vérifie|a vu|a signé|part|arrive|appelle|s'occupe de|suit|et moi|aussi|encore",
    "es": "dice|dijo|escribe|escribió|pregunta|preguntó|piensa|encontró|respondió|avisó|confirmó|quiere|va a|ha|había|es|está|puede|asume|asumió|revisa|revisó|comprueba|vio|firmó|sale|llega|llama|se encarga de|lleva|y yo|también|todavía",
}
_LABELS = {
    "person": """Author Owner Reviewer Contact Assignee Reporter Name Editor Maintainer Approver Attendee Speaker Signed Prepared-by Signed-off-by Reviewed-by Acked-by Tested-by Co-authored-by Reported-by Cc To From Attn Lead Manager Backup
 Verfasser Autor Autorin Prüfer Prüferin Kontakt Ansprechpartner Ansprechpartnerin Bearbeiter Zuständig Teilnehmer Vertretung An Von Auteur Relecteur Responsable Rédacteur Nom Correspondant De À Autor Revisor Revisora Responsable Contacto Nombre Encargado Para owner author user name reviewer""".split(),
    "email": "Email E-mail e-mail Mail mail Contact Reply-To To Cc From Kontakt E-Mail Mailadresse Antwort Courriel Mél Adresse Correo Contacto Dirección email user address".split(),
    "phone": "Phone phone Tel Tel. Telephone Mobile Cell Fax Call Hotline Telefon Mobil Handy Durchwahl Rufnummer Tél. Téléphone Portable Télécopie Teléfono Tlf. Tfno. Móvil tel".split(),
    "address": "Address address Home Office Location Delivery Ship-to Postal Residence Anschrift Adresse Wohnort Lieferadresse Büro Domicile Livraison Dirección Domicilio Envío Oficina".split(),
}
#: Kinds of phrases around the other mentions; @ is the mention.
_PHRASES = {
    "email": {
        "en": "write to @|mail @|send it to @|send the ~ to @|reach me at @|copies go to @|the list is @|subscribed as @|bounced from @|forwarded to @|questions to @|@ bounced|@ is the address|contact @ for ~|or use @|reply to @ only|(@)|<@>|mailto:@",
        "de": "Rückfragen an @|bitte an @ schicken|schreiben Sie an @|Mail an @|Kopie an @|erreichbar unter @|die Adresse ist @|weiter an <@>|mailto:@|(@)|@ antwortet nicht",
        "fr": "écrire à @|écrivez à @|envoyer à @|joignable à @|copie à @|questions à @|l'adresse est @|<@>|mailto:@|(@)|@ ne répond pas",
        "es": "escribir a @|escriba a @|enviar a @|copia a @|dudas a @|la dirección es @|disponible en @|<@>|mailto:@|(@)|@ no responde",
    },
    "phone": {
        "en": "call @|call me on @|ring @|reach us at @|text @|the number is @|dial @ for ~|phone @|fax @|or by phone: @|at @ until noon|@ after six|(@)|the line is @|mobile @|leave a message on @",
        "de": "unter @ erreichbar|bitte @ anrufen|Anruf unter @|Tel. @|Telefon @|Fax @|mobil @|die Nummer ist @|Rückruf unter @|oder unter @|(@)",
        "fr": "appeler le @|joindre le @|au @|tél. @|par téléphone au @|le numéro est le @|fax @|portable @|rappeler le @|(@)",
        "es": "llamar al @|llame al @|en el @|tel. @|por teléfono al @|el número es el @|fax @|móvil @|devolver la llamada al @|(@)",
    },
    "address": {
        "en": "lives at @|moved to @|the office is at @|send it to @|deliver to @|ship to @|meet at @|visit @|parcel for @|mail goes to @|the house at @|our place, @|registered at @|letters to @|at @ now|from @ to ~",
        "de": "wohnt in der @|Brief an @|bitte an @ schicken|Paket an @|das Büro ist @|umgezogen nach @|Treffpunkt @|Lieferung an @|gemeldet in @|Besuch in @|jetzt @",
        "fr": "habite au @|expédier au @|lettre au @|colis au @|le bureau est au @|déménagé au @|livrer au @|rendez-vous au @|domicilié au @|maintenant @",
        "es": "vive en @|mandar a @|sobre a @|paquete a @|la oficina está en @|mudado a @|entregar en @|cita en @|domiciliado en @|ahora @",
    },
    "id_number": {
        "en": "@|shown as @|we found @ in the ~|the scan shows @|attached: @|@ on file|copy of @|please remove @|(@)|line with @|quoted @ twice|@, valid|@ (renewed)",
        "de": "@|dort steht @|eingetragen: @|gefunden: @|bitte @ löschen|Kopie von @|(@)|@, gültig|laut ~ @",
        "fr": "@|on y lit @|inscrit : @|trouvé : @|merci de retirer @|copie de @|(@)|@, valable|dans le ~ : @",
        "es": "@|se lee @|inscrito: @|encontrado: @|por favor borrar @|copia de @|(@)|@, vigente|en la ~ consta @",
    },
}
_PHRASES = {k: {lang: p.split("|") for lang, p in v.items()} for k, v in _PHRASES.items()}
_BEFORE, _AFTER = ({lang: [x.strip() for x in p.split("|")] for lang, p in side.items()} for side in (_BEFORE, _AFTER))

#: Public formats of identity numbers with labels: # a digit, A a letter.
_IDENTITIES = [
    ("SSN|SSN|Social Security Number|social security number|social security no.|Soc. Sec. No.|social security", "###-##-####|###-##-####|### ## ####|#########"),
    ("National Insurance number|National Insurance no.|NINO|NI number", "AA ## ## ## A|AA######A"),
    ("passport|Passport|passport no.|passport no|Passport No.|passport number|Passport number|travel document", "A########|AA#######|#########|A##A#####|##AA#####|AAA######|A########A"),
    ("Reisepass|Pass-Nr.|Reisepassnummer|Passnummer|Personalausweis|Ausweis-Nr.|Ausweisnummer|Personalausweisnummer", "A##A##A##|AA#######|A########|A##A#####|A###A##A#"),
    ("Steuer-ID|Steuer-IdNr.|IdNr.|Steueridentifikationsnummer|Steuer-Identifikationsnummer", "## ### ### ###|###########"),
    ("Steuernummer|St.-Nr.|Steuer-Nr.", "##/###/#####|###/####/####|## ### #####|###/###/#####"),
    ("Sozialversicherungsnummer|SV-Nummer|Rentenversicherungsnummer|RVNR", "## ###### A ###|########A###"),
    ("NIR|n° de sécurité sociale|numéro de sécurité sociale|numéro de sécu|n° INSEE|sécurité sociale", "# ## ## ## ### ### ##|# ## ## ### ### ## ##|###############"),
    ("passeport|passeport n°|n° de passeport|numéro de passeport|carte d'identité|CNI|carte nationale d'identité", "##AA#####|############|AA#######|A########|A##A#####"),
    ("numéro fiscal|n° fiscal|SPI|identifiant fiscal", "## ## ### ### ###|#############|##########"),
    ("DNI|DNI|NIF|DNI/NIF|documento nacional de identidad|documento", "########A|########-A|##.###.###-A|######## A"),
    ("NIE|NIE/TIE", "A#######A|A-#######-A"),
    ("pasaporte|pasaporte n.º|número de pasaporte|n.º de pasaporte", "AAA######|AA#######|A########|A##A#####"),
    ("Seguridad Social|número de la Seguridad Social|NUSS|n.º de afiliación", "## ######## ##|############|##/########/##"),
    ("tax ID|tax id|TIN|EIN|tax number|taxpayer number|tax no.|VAT ID|tax file number", "##-#######|##########|### ### ###|#########|### ## ####"),
    ("national ID|national id|ID card|identity card|ID number|ID no.|personal number|identity number|national identity number", "##########|######-####|AA######|A#######|###########|######## ####|AA ### ###"),
]
_PHONES = """+1 ###-###-####|+1 (###) ###-####|+1 ### ### ####|+1.###.###.####|1-###-###-####|(###) ###-####|(###) ###-####|###-###-####|###-###-####|###.###.####|### ### ####|+44 20 #### ####|+44 ## #### ####|+44 7### ######|+44 (0)20 #### ####|
020 #### ####|0### ### ####|0#### ######|07### ######|07### ### ###|+49 ## #######|+49 ### ######|+49 (0)## #######|+49 (0)## ##### ###|+49-##-#######|+49 ## #### ####|+49 ### ### ## ##|0##/#######|0##/########|0### #######|0##-#######|0### / ######|(0##) #######|
+33 # ## ## ## ##|+33 (0)# ## ## ## ##|0# ## ## ## ##|0#.##.##.##.##|0#-##-##-##-##|+34 ### ### ###|+34 ### ## ## ##|9## ### ###|6## ## ## ##|6## ### ###|0049 ## #######|0033 # ## ## ## ##|0034 ### ### ###|+41 ## ### ## ##|+43 1 #######|+351 ### ### ###|+39 ## #######|+## ## #######|+## ### ### ###"""
_PHONES = [p.strip() for p in _PHONES.split("|")]
_EXTENSIONS = [" x##", " x###", " x####", " ext. ##", " ext. ###", " ext ###", " extension ###", ", ext. ##", " Durchwahl ##", " App. ##", " poste ##", " ext.: ###", " int. ##", "-##"]

_STREET_EN = "Street Street St. St Road Road Rd. Rd Avenue Avenue Ave. Ave Lane Lane Ln. Drive Drive Dr. Court Court Close Close Way Way Place Terrace Square Boulevard Blvd. Crescent Row Walk Hill Gardens Grove Parkway Mews".split()
_STREET_WORDS = "Oak Elm Maple Cedar Pine Willow Church Station High Park Mill River Lake Spring Victoria King Queen Market Bridge Castle Garden Chestnut Main School Green Abbey Meadow Orchard North South Hill Sunset Washington Lincoln".split()
_STREET_DE = "Haupt Bahnhof Garten Schul Dorf Kirch Berg Linden Rosen Wald Ring Goethe Schiller Mozart Markt Mühlen Birken Eichen Buchen Feld Brunnen Post Kaiser Bach Tannen Wiesen".split()
_STREET_FR = "Victor Hugo|Pasteur|Jean Jaurès|de la République|de la Paix|des Lilas|du Moulin|de l'Église|des Écoles|Gambetta|de Paris|du Château|Voltaire|des Fleurs|du Pont|de la Gare|Saint-Michel|des Tilleuls|Molière".split("|")
_STREET_ES = "Mayor|Real|del Sol|de la Constitución|San Juan|Santa Ana|de Alcalá|Cervantes|del Carmen|Nueva|de la Paz|Goya|Velázquez|del Prado|de los Olivos|San Miguel|Colón|Ramón y Cajal".split("|")

#: What names of things follow; they look like names of people or streets and are none.
_THING_BEFORE = """Project Release Module Team Squad Milestone Codename Sprint Branch Feature Service Component Library Package Build Version Milestone Epic Theme Pipeline Dataset Model Report Chapter Track Stage Task Suite
 Projekt Ausgabe Modul Team Gruppe Dienst Fassung Meilenstein Paket Bereich Projet Module Équipe Version Service Lot Composant Proyecto Módulo Equipo Versión Servicio Entrega Paquete""".split()
_THING_AFTER = "team desk squad release project module build rollout launch crew group service library suite track board channel milestone branch guild program initiative Team Desk Squad Release Project Module Board Group Crew Guild".split()
_THING_WORDS = "Silver Blue Red Amber Crystal Iron Golden Silent Rapid Northern Bright Copper Falcon Tiger Harbor Summit Comet River Canyon Delta Phoenix Orion Horizon Beacon Anchor Lantern Compass Atlas Maple Cedar Willow Victor Mercury Apollo Juno Ruby Jasmine Aurora Merge Layout Search Index Report Data Quality Core Review".split()
_NUMBER_BEFORE = """run task build job ticket issue PR commit revision order line lines page port pid id batch shard row rows offset size bytes checksum hash version step case request session trace block chunk
 Lauf Auftrag Vorgang Zeile Zeilen Seite Nummer Stand Prüfsumme Bau ligne lignes page tâche lot numéro version línea líneas página tarea lote número versión compilación""".split()


class _Draw:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.pick, self.chance = self.r.choice, self.r.random

    def fill(self, form: str) -> str:
        """Digits for #, letters for A."""
        return "".join(self.pick("0123456789") if c == "#" else self.pick("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "A" else c for c in form)

    def digits(self, least: int, most: int) -> str:
        return self.fill("#" * self.r.randint(least, most))

    def made(self, least: int = 1, most: int = 3) -> str:
        return "".join(self.pick(_ONSET) + self.pick(_NUCLEUS) + (self.pick(_CODA) if self.chance() < 0.5 else "") for _ in range(self.r.randint(least, most)))

    def made_name(self) -> str:
        return (self.made(1, 2) + self.pick(_NAME_END)).capitalize()

    # --- the five kinds

    def first(self) -> str:
        return self.pick(_FIRST) if self.chance() < 0.6 else self.made(1, 2).capitalize() + self.pick(["", "", "a", "e", "o", "is", "an"])

    def last(self) -> str:
        return self.pick(_LAST) if self.chance() < 0.4 else self.made_name()

    def person(self) -> str:
        p = self.chance
        first, last = self.first(), self.last()
        initial = lambda: self.pick("ABCDEFGHIJKLMNOPRSTUVWYZÉ") + "."
        if p() < 0.1:
            first += "-" + self.first()
        if p() < 0.13:
            last += "-" + self.last()
        elif p() < 0.06:
            last += self.pick([" ", " y "]) + self.last()
        if p() < 0.15:
            last = self.pick(_PARTICLES) + " " + last
        elif p() < 0.03:
            last = self.pick(["d'", "D'", "Mac", "Fitz", "al-", "O'"]) + last
        if p() < 0.2:
            first = initial() + (self.pick([" ", ""]) + initial() if p() < 0.25 else "")
        elif p() < 0.2:
            first += " " + (initial() if p() < 0.75 else self.first())
        way = p()
        name = f"{last}, {first}" if way < 0.12 else f"{last.upper()}, {first}" if way < 0.14 else f"{first} {last.upper()}" if way < 0.16 else f"{first} {last}"
        return name.upper() if p() < 0.07 else name

    def email(self) -> str:
        p, plain = self.chance, lambda w: "".join(c for c in w.lower().translate(str.maketrans("éèêëáàâäíïóöôúüñçşğı", "eeeeaaaaiiooouuncsgi")) if c.isascii() and c.isalnum())
        first, last = plain(self.first()), plain(self.last())
        local = self.pick([f"{first}.{last}", f"{first}.{last}", f"{first}_{last}", f"{first[0]}{last}", f"{first[0]}.{last}", f"{first}", f"{last}{self.digits(1, 3)}", f"{first}-{last}", f"{first}.{last}{self.digits(1, 2)}"])
        if p() < 0.12:
            local += "+" + self.pick(_WORDS["en"][0])
        elif p() < 0.06:
            local = self.pick(["info", "support", "office", "kontakt", "team", "no-reply", "hello", "contacto"])
        ends = ["com", "org", "net", "de", "fr", "es", "io", "eu", "co.uk", "info", "dev", "edu", "test", "example", "invalid", "example.com", "example.org", "example.net", "ch", "at"]
        host = self.pick(["", "", "", "mail.", "post.", "lists.", "smtp-", "corp."]) + self.pick([plain(self.made(2, 3)), self.pick([w for w in _WORDS["en"][0] if w.isascii()]), f"{plain(self.made(1, 2))}-{plain(self.made(1, 2))}", "example"]) + "." + self.pick(ends)
        at, dot = self.pick([("(at)", "."), ("[at]", "."), (" (at) ", "."), (" [at] ", "."), (" at ", " dot "), (" at ", " dot "), (" at ", "."), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" AT ", " DOT "), ("{at}", "{dot}"), (" ät ", " punkt "), (" arroba ", " punto "), (" arobase ", " point "), (" @ ", ".")]) if p() < 0.4 else ("@", ".")
        out = local + at + host.replace(".", dot)
        if at == " at " and dot == "." and p() < 0.5:
            out = local.replace(".", " dot ") + at + host.replace(".", " dot ")
        return out.upper() if p() < 0.05 else out

    def phone(self) -> str:
        return self.fill(self.pick(_PHONES) + (self.pick(_EXTENSIONS) if self.chance() < 0.2 else ""))

    def identity(self) -> tuple[str, str]:
        labels, forms = self.pick(_IDENTITIES)
        label = self.pick(labels.split("|"))
        label += self.pick([": ", ": ", " ", " ", " ", " : ", "=", " is ", " # ", " Nr. ", " n° ", ":"])
        value = self.fill(self.pick(forms.split("|")))
        return label, value.lower() if self.chance() < 0.02 else value

    def street_word(self, known: list[str]) -> str:
        return self.pick(known) if self.chance() < 0.4 else self.made_name()

    def address(self) -> str:
        p, pick, n = self.chance, self.pick, str(self.r.randint(1, 250))
        unit = self.r.randint(1, 60)
        lang = pick(["en", "en", "en", "de", "de", "fr", "fr", "es", "es"])
        if lang == "en":
            n += pick(["", "", "", "", "", "A", "B", "-" + self.digits(1, 2)])
            name = self.street_word(_STREET_WORDS) + (" " + self.street_word(_STREET_WORDS) if p() < 0.12 else "")
            if p() < 0.08:
                name = pick(["North", "South", "East", "West", "N.", "S.", "E.", "W."]) + " " + name
            street = f"{n} {name} {pick(_STREET_EN)}"
            way = p()
            if way < 0.1:
                return pick([f"Flat {unit}, ", f"Flat {unit}{pick('ABC')}, ", f"Unit {unit}, ", f"Apt {unit}, ", f"Suite {unit}, ", f"Apartment {unit}, "]) + street
            return street + (pick([f", Apt {unit}", f", Apt. {unit}", f" Apt {unit}", f", Unit {unit}", f", Flat {unit}", f", Suite {unit}", f" #{unit}", f", #{unit}", f", Apt {unit}{pick('ABC')}", f", Floor {unit}", f" Unit {unit}"]) if way < 0.4 else "")
        if lang == "de":
            n += pick(["", "", "", "", "a", "b", "c", " a", "-" + self.digits(1, 2), "/" + self.digits(1, 1)])
            name = self.street_word(_STREET_DE)
            street = pick([f"{name}straße {n}", f"{name}straße {n}", f"{name}str. {n}", f"{name}weg {n}", f"{name}gasse {n}", f"{name}platz {n}", f"{name}allee {n}", f"{name}ring {n}", f"{name}-Straße {n}", f"{name}er Straße {n}", f"{name}-Allee {n}", f"{name}-Weg {n}", f"Am {name} {n}", f"An der {name} {n}", f"Im {name} {n}", f"Zum {name} {n}", f"Auf dem {name} {n}", f"{name}ufer {n}", f"{name}damm {n}"])
            return street + (pick([f", Wohnung {unit}", f", Whg. {unit}", f", {self.r.randint(1, 9)}. OG", f", {self.r.randint(1, 9)}. Stock", f", App. {unit}"]) if p() < 0.12 else "")
        if lang == "fr":
            n += pick(["", "", "", "", " bis", " ter", " B"])
            name = pick(_STREET_FR) if p() < 0.4 else pick(["", "de ", "du ", "de la ", "des ", "de l'", "le "]) + self.made_name()
            street = f"{n}{pick([' ', ', ', ' '])}{pick(['rue', 'rue', 'rue', 'avenue', 'av.', 'boulevard', 'bd', 'chemin', 'place', 'impasse', 'allée', 'quai', 'route', 'Rue', 'Avenue', 'cours', 'passage'])} {name}"
            return street + (pick([f", appt {unit}", f", appartement {unit}", f", apt. {unit}", f", bâtiment {pick('ABCD')}", f", bât. {pick('ABCD')}", f", étage {self.r.randint(1, 9)}", f", {self.r.randint(2, 9)}e étage"]) if p() < 0.18 else "")
        name = pick(_STREET_ES) if p() < 0.4 else pick(["", "", "de ", "del ", "de la ", "de los "]) + self.made_name()
        street = f"{pick(['Calle', 'Calle', 'C/', 'C.', 'Avenida', 'Avda.', 'Av.', 'Plaza', 'Pza.', 'Paseo', 'Camino', 'Ronda', 'Carrera', 'Travesía', 'calle'])} {name}{pick([' ', ', ', ' ', ', n.º ', ' nº '])}{n}"
        floor = self.r.randint(1, 9)
        return street + (pick([f", {floor}.º {pick('ABCD')}", f", {floor}º {pick('ABCD')}", f", {floor}.º izq.", f", {floor}º dcha.", f", piso {floor}", f", piso {floor}, puerta {pick('ABCD')}", f", {floor} {pick('ABCD')}", f", puerta {unit}", f", bajo {pick('ABCD')}"]) if p() < 0.35 else "")

    # --- all else

    def thing(self) -> str:
        """A name that isn't a person's."""
        return " ".join(self.pick([self.pick(_THING_WORDS), self.pick(_THING_WORDS), self.pick(_THING_WORDS), self.made_name(), self.last(), self.pick(_STREET_WORDS), self.first() if self.chance() < 0.3 else self.made_name(), self.pick(_WORDS["en"][0]).capitalize()]) for _ in range(self.pick([1, 2, 2, 2, 2, 3])))

    def named_thing(self) -> str:
        t = self.thing()
        if self.chance() < 0.12:
            t = self.pick(_STREET_WORDS + [self.made_name()]) + " " + self.pick([s for s in _STREET_EN if len(s) > 3])
        way = self.chance()
        if way < 0.55:
            b = self.pick(_THING_BEFORE)
            return f"{b if self.chance() < 0.7 else b.lower()} {t}" + (f" {self.pick(_THING_AFTER)}" if self.chance() < 0.12 else "")
        if way < 0.9:
            return self.pick(["the ", "the ", "The ", "our ", "das ", "l'", "la ", "el ", "", ""]) + t + " " + self.pick(_THING_AFTER)
        return self.pick(["the ", "The ", ""]) + f"{t} {self.pick(_THING_AFTER)} {self.pick(_WORDS['en'][0])}"

    def module(self) -> str:
        a, b = self.made(1, 3), self.pick([self.made(1, 2), self.pick(_WORDS["en"][0])])
        return self.pick([a, a, a, f"{a}-{b}", f"{a}_{b}", f"{a}.{b}", f"{a}/{b}", a + b.capitalize(), f"{a}{self.digits(1, 2)}"])

    def file(self) -> str:
        return self.pick(["", "", "src/", "./", "docs/", f"{self.made()}/", "../"]) + self.module() + self.pick(["-", "_", "."]) + self.pick(_WORDS["en"][0]) + "." + self.pick("md txt ts js json mjs py yaml csv log html sh cfg toml".split())

    def hexa(self, n: int) -> str:
        return "".join(self.pick("0123456789abcdef") for _ in range(n))

    def number(self) -> str:
        d = self.digits
        return self.pick([
            lambda: d(1, 3), lambda: d(1, 3), lambda: d(1, 6), lambda: f"{d(1, 2)}.{d(1, 2)}.{d(1, 2)}", lambda: f"v{d(1, 2)}.{d(1, 2)}.{d(1, 3)}", lambda: f"{d(1, 3)}.{d(1, 3)}", lambda: f"{d(1, 3)}%", lambda: f"{d(1, 3)} %", lambda: f"0.{d(2, 6)}",
            lambda: self.fill("20##-##-##"), lambda: self.fill("20##-##-##T##:##:##Z"), lambda: self.fill("20##-##-## ##:##"), lambda: self.fill("##.##.20##"), lambda: self.fill("##/##/20##"), lambda: self.fill("##:##:##"), lambda: self.fill("##:##"), lambda: self.fill("20######-######"), lambda: self.fill("20##.##.##"),
            lambda: f"{d(1, 4)}-{d(1, 4)}", lambda: f"{d(3, 4)}-{d(2, 3)}-{d(3, 5)}", lambda: f"{d(2, 5)}/{d(2, 5)}", lambda: f"{d(1, 3)},{d(3, 3)}", lambda: f"{d(1, 3)},{d(3, 3)},{d(3, 3)}", lambda: f"{d(1, 3)} {d(3, 3)}", lambda: f"#{d(1, 5)}", lambda: self.hexa(self.pick([7, 8, 12, 16, 32, 40, 64])),
            lambda: "-".join(self.hexa(k) for k in (8, 4, 4, 4, 12)), lambda: f"{d(1, 3)}.{d(1, 3)}.{d(1, 3)}.{d(1, 3)}", lambda: d(7, 14), lambda: f"{self.pick('ABCDEFGHKLMNPRSTX')}{self.pick('ABCDEFGHKLMNPRSTX')}{self.pick('ABCDEFGHKLMNPRSTX')}-{d(2, 6)}", lambda: f"{d(1, 4)} ms", lambda: f"{d(1, 3)}.{d(1, 2)} s", lambda: f"{d(1, 4)} kB", lambda: f"{d(3, 3)}-{d(2, 2)}-{d(4, 4)}", lambda: f"{d(3, 3)}-{d(3, 4)}",
        ])()

    def counted(self) -> str:
        before = self.pick(_NUMBER_BEFORE)
        return f"{before if self.chance() < 0.8 else before.capitalize()}{self.pick([' ', ' ', ' ', ' #', '=', ': ', '-', ' no. '])}{self.number()}"

    def noun(self, lang: str) -> str:
        """A known noun, or one put together."""
        if self.chance() < 0.65:
            return self.pick(_WORDS[lang][0])
        made = self.made(1, 2) + (self.pick(_NOUN_ENDS) if self.chance() < 0.7 else "")
        return made.capitalize() if lang == "de" else made

    def adjective(self, lang: str) -> str:
        return self.pick(_WORDS[lang][1]) if self.chance() < 0.75 else self.made(1, 2) + self.pick(["ig", "lich", "al", "ous", "able", "ed", "o", "e", "ant", ""])

    def named(self, lang: str) -> str:
        """Something with a name, a number or an article: what a phrase is about."""
        p, pick = self.chance, self.pick
        way = p()
        if way < 0.12:
            return self.module()
        if way < 0.17:
            return self.file()
        if way < 0.21:
            return self.counted()
        if way < 0.25:
            return self.number() + " " + self.noun(lang)
        if way < 0.28:
            return self.named_thing()
        if way < 0.31:
            return self.noun(lang) + " " + self.noun(lang)
        if way < 0.38:  # an enumeration
            return ", ".join(self.noun(lang) for _ in range(self.r.randint(1, 3))) + pick([" ", " ", ", "]) + pick(_WORDS[lang][5][:1]) + " " + pick([self.noun(lang), self.number() + " " + self.noun(lang)])
        return (pick(_WORDS[lang][3]) + " " if p() < 0.8 else "") + (self.adjective(lang) + " " if p() < 0.4 else "") + self.noun(lang) + (" " + self.noun(lang) if lang == "de" and p() < 0.12 else "")

    def phrase(self, lang: str) -> str:
        p, pick = self.chance, self.pick
        verb = self.copula(lang) if p() < 0.3 else (pick(_WORDS[lang][2]) if p() < 0.7 else self.made(1, 2) + pick(["s", "t", "e", "a", "es"])) + (" " + self.named(lang) if p() < 0.85 else "")
        out = self.named(lang) + " " + verb
        if p() < 0.12:  # led in by a preposition, so the verb may come first
            lead = pick(_WORDS[lang][4]) + " " + self.named(lang)
            out = pick([f"{lead} {verb.split(' ')[0]} {self.named(lang)} {verb.partition(' ')[2]}".strip(), f"{lead}, {out}", f"{lead} {out}"])
        while p() < 0.4:
            out += " " + pick(_WORDS[lang][4]) + " " + self.named(lang)
        return out

    def copula(self, lang: str) -> str:
        return self.pick(_COPULAS[lang]) + " " + self.pick(_DEGREES[lang]) + self.adjective(lang)

    def clause(self, lang: str, words: int | None = None) -> str:
        out = self.phrase(lang)
        if self.chance() < 0.3:
            out += self.pick([", ", " "]) + self.pick(_WORDS[lang][5]) + " " + self.phrase(lang)
        return " ".join(out.split(" ")[:words]) if words else out

    def sentence(self, lang: str) -> str:
        s = self.clause(lang)
        if self.chance() < 0.1:
            s = self.pick(["Note: ", "TODO: ", "Q: ", "A: ", "NB ", "Hinweis: ", "Remarque : ", "Nota: ", "FIXME ", "Warning: "]) + s
        return s[0].upper() + s[1:] + self.pick([".", ".", ".", ".", ".", "?", "!", ":", ";", ""])

    def heading(self, lang: str) -> str:
        words = [self.pick([self.noun, self.noun, self.adjective])(lang) for _ in range(self.r.randint(1, 5))]
        words = [w.capitalize() if self.chance() < 0.85 or i == 0 else w for i, w in enumerate(words)]
        if self.chance() < 0.4:
            words.insert(self.r.randint(0, len(words)), self.pick([self.module(), self.number(), self.module(), self.pick(_THING_WORDS)]))
        s = self.pick(["# ", "## ", "### ", "= ", "== ", "- ", "* ", "> ", "**", "", "", "1. ", "2) "]) + " ".join(words)
        return s.upper() if self.chance() < 0.12 else s

    def plain(self, lang: str) -> str:
        way, pick, n = self.chance(), self.pick, self.number
        if way < 0.5:
            return self.sentence(lang)
        if way < 0.62:
            return self.heading(lang)
        if way < 0.7:
            s = self.sentence(lang)
            return pick(["- ", "* ", "> ", "+ ", "| ", "• ", "1. ", "[ ] ", "- [x] "]) + pick([s, s.title(), s.upper(), s])
        if way < 0.77:
            return self.named_thing()[:1].upper() + self.named_thing()[1:] + " " + self.clause(lang) + pick([".", "", "."])
        if way < 0.81:
            return self.counted() + pick([" ", ", ", " of "]) + pick([self.counted(), self.clause(lang), n(), self.module()]) + pick(["", ".", ""])
        m, k = self.module, lambda: pick(_WORDS["en"][0])
        return pick([
            lambda: f"[{self.fill('##:##:##')}] {pick(['INFO', 'WARN', 'ERROR', 'DEBUG'])} {m()} {k()}={n()}", lambda: f"{self.fill('20##-##-## ##:##:##')} {pick(['INFO', 'WARN', 'ERROR'])} {m()}: {self.clause('en')}", lambda: f"{k()}={n()} {k()}={n()} {k()}={m()}",
            lambda: f"commit {self.hexa(40)}", lambda: f"index {self.hexa(7)}..{self.hexa(7)} 100644", lambda: f"@@ -{n()},{self.digits(1, 2)} +{self.digits(1, 3)},{self.digits(1, 2)} @@ {m()}", lambda: f"diff --git a/{self.file()} b/{self.file()}", lambda: f"origin\tgit@{m()}.{pick(['com', 'org', 'test', 'invalid', 'example', 'dev'])}:{m()}/{m()}.git ({pick(['fetch', 'push'])})",
            lambda: f"git clone git@{m()}.{pick(['com', 'org', 'test', 'invalid', 'example', 'io'])}:{m()}/{m()}.git", lambda: f"{pick(['remote', 'upstream', 'mirror', 'clone', 'fetch'])} {pick(['git', 'ssh://git', 'deploy', 'hg', 'svn'])}@{m()}.{pick(['net', 'org', 'test', 'invalid', 'example'])}{pick([':', '/'])}{m()}/{m()}{pick(['', '.git'])}", lambda: f"ssh://git@{m()}.org:{self.digits(2, 4)}/{m()}.git", lambda: f"https://{m()}.{pick(['com', 'org', 'test', 'example'])}/{m()}/{m()}?{k()}={n()}",
            lambda: f"{m()}@{self.digits(1, 2)}.{self.digits(1, 2)}.{self.digits(1, 2)}", lambda: f"@{m()}/{m()}@{self.digits(1, 2)}.{self.digits(1, 2)}.{self.digits(1, 2)}", lambda: f"{pick(['@', ''])}{m()}{pick(['/' + k(), ''])}@{pick(['^', '~', ''])}{self.digits(1, 1)}.{self.digits(1, 2)}.{self.digits(1, 2)} {self.clause('en', 3)}", lambda: f"  \"{m()}\": \"^{self.digits(1, 2)}.{self.digits(1, 2)}.{self.digits(1, 2)}\",", lambda: f"uses: {m()}/{m()}@v{self.digits(1, 1)}", lambda: f"image {m()}@sha256:{self.hexa(64)}", lambda: f"{self.hexa(64)}  {self.file()}",
            lambda: f"{k()}: {n()}", lambda: f"{m()}: {n()}, {n()}, {n()}", lambda: f"{{\"{k()}\": {self.digits(1, 5)}, \"{k()}\": \"{m()}\"}}", lambda: f"function {m()}({k()}) {{", lambda: f"  return {m()}.{k()}({k()}, {n()});", lambda: f"const {k()} = {m()}(\"{k()}\", {self.digits(1, 3)});", lambda: f"if ({k()} !== \"{m()}\") {{", lambda: "}", lambda: "```", lambda: f"| {k()} | {n()} | {n()} |", lambda: f"| {k()} | {self.thing()} | {n()} |", lambda: f"{k()};{m()};{n()};{self.digits(1, 4)}", lambda: f"{k()}\t{n()}\t{m()}",
            lambda: f"{self.file()}:{self.digits(1, 4)}:{self.digits(1, 2)} {self.clause('en')}", lambda: f"{n()} {pick(['of', 'von', 'sur', 'de'])} {n()} {pick(_WORDS[lang][0])}", lambda: f"{self.counted()} {self.counted()} {self.counted()}",
            lambda: f"{pick(['See', 'see', 'cf.', 'siehe', 'voir', 'véase'])} {self.file()} {self.counted()}", lambda: self.pick("0123456789=-*#x") * self.r.randint(3, 40), lambda: self.digits(12, 30), lambda: f"{' '.join(pick(_THING_WORDS) for _ in range(2))}: {self.clause(lang)}", lambda: f"{pick(_THING_WORDS)} {self.noun('en').capitalize()} | {n()} | {m()}",
            lambda: self.sentence(lang).upper(), lambda: self.sentence(lang).title(), lambda: " ".join(pick(["**", "|", "", ""]) + w for w in self.sentence(lang).upper().split(" ")),
        ])()

    def value(self, kind: str) -> tuple[str, str]:
        """What stands before a mention and belongs to it without being part of it, and the mention."""
        if kind == "id_number":
            return self.identity()
        if kind == "person":
            return (self.pick(_TITLES) if self.chance() < 0.1 else ""), self.person()
        return "", {"email": self.email, "phone": self.phone, "address": self.address}[kind]()

    def town(self) -> str:
        name = self.pick(_TOWNS) if self.chance() < 0.4 else self.made_name()
        if self.chance() < 0.12:
            name = self.pick(["Bad ", "Saint-", "San ", "Santa ", "Port ", "New ", "Nord", "Villa ", "St. "]) + name
        code = self.pick(["#####", "#####", "####", "AA# #AA", "##### ####", "D-#####", "F-#####"])
        return self.pick([f"{self.fill(code)} {name}", name, f"{name} {self.fill(code)}", f"{name}, AA {self.fill('#####')}", name])

    def mentioning(self, lang: str) -> list[tuple[str, str | None]]:
        """Parts of a line: texts, and mentions with their kinds."""
        p, pick = self.chance, self.pick
        kind = pick(["person", "person", "person", "person", "person", "email", "phone", "address", "address", "id_number"])
        way = p()
        if way < 0.16:  # a record of several mentions
            kinds = pick([["person", "email"], ["person", "email", "phone"], ["person", "phone"], ["person", "address", "phone"], ["person", "address"], ["person", "id_number"], ["email", "phone"], ["person", "person", "email"], ["person", "email", "address"]])
            sep = pick([" | ", " | ", ";", "; ", ", ", " - ", " – ", "\t", " / ", ",", " · "])
            out: list[tuple[str, str | None]] = [(pick(["", "", "", "| ", "- ", "* ", "• ", self.digits(1, 4) + ";", self.module() + sep]), None)]
            for i, k in enumerate(kinds):
                if i:
                    out.append((sep, None))
                before, value = self.value(k)
                wrap = ("<", ">") if k == "email" and p() < 0.2 else ("(", ")") if k in ("email", "phone") and p() < 0.1 else ("", "")
                if wrap[0] and len(out) > 1:
                    out[-1] = (" ", None)
                label = pick(_LABELS[k]) + pick([": ", "=", " ", ": "]) if k in _LABELS and p() < 0.15 else ""
                out += [(label + before + wrap[0], None), (value, k), (wrap[1], None)]
                if k == "address" and p() < 0.35:
                    out.append((", " + self.town(), None))
            return [*out, (pick(["", "", "", " |", ".", f"{sep}{self.module()}", f"{sep}{self.number()}"]), None)]
        if way < 0.2 and kind == "person":  # several names
            sep, out = pick([", ", ", ", "; ", " / ", " & "]), [(pick([*_BEFORE[lang], *_LABELS["person"]]) + pick([": ", " ", ": "]), None)]
            for i in range(self.r.randint(2, 4)):
                out += [(sep, None)] * (i > 0) + [(self.person(), kind)]
            return [*out, (pick(["", "", ".", " " + self.clause(lang)]), None)]
        before, value = self.value(kind)
        town = [(pick([", ", ", ", " - ", " "]) + self.town(), None)] if kind == "address" and p() < 0.35 else []
        mention: list[tuple[str, str | None]] = [(before, None), (value, kind), *town]
        if way < 0.36:  # a label, or nothing
            if kind in _LABELS and p() < 0.55:
                label = pick(_LABELS[kind]) if p() < 0.8 else self.clause(lang, self.r.randint(1, 4)).capitalize()
                if p() < 0.12:
                    label = pick(["- ", "* ", "**", "  ", "| "]) + label
                return [(label + pick([": ", ": ", ": ", " : ", "=", " = ", ":", " - ", ";", " "]), None), *mention, (pick(["", "", "", ".", ";", f" {pick(['-', '|', ','])} {self.clause(lang, 4)}", f"; {self.pick(_WORDS['en'][0])}={self.module()}"]), None)]
            return [(pick(["", "", "", "- ", "— ", "-- ", "* ", "> ", "  ", "@ " if kind == "person" else ""]), None), *mention, (pick(["", "", "", ",", "."]), None)]
        if kind == "person":
            if way < 0.42:
                em = self.email()
                return [(pick([*(f"{label}: " for label in _LABELS["person"][10:17]), "From: ", "To: ", "", "", "* ", "- "]), None), (self.person(), "person"), (" <", None), (em, "email"), (pick([">", ">", "> wrote:", "> schrieb:", "> a écrit :", "> escribió:", ">,"]), None)]
            if p() < 0.14:
                when = pick([" " + pick(_WHEN[lang]), " " + pick(_WHEN[lang]), "", ", " + pick(_WHEN[lang])]) + pick([".", ".", "", ","])
                if lang == "en":
                    return [(f"{self.named(lang)} {pick(['was', 'is', 'has been', 'got', 'were'])} {pick(_PASSIVE)} by ", None), *mention, (when, None)]
                if lang == "de":
                    return [(pick(["Bitte ", "bitte ", "Wir müssen ", "Wer kann ", "Heute noch "]), None), *mention, (pick([f" nach {self.named(lang)}", f" zu {self.named(lang)}", f" wegen {self.named(lang)}", ""]) + " " + pick(_VERBLAST) + pick([".", ".", "?", ""]), None)]
                return [(f"{self.named(lang)} {self.pick(_COPULAS[lang])} {self.adjective(lang)} {'par' if lang == 'fr' else 'por'} ", None), *mention, (when, None)]
            if p() < 0.12:  # an opinion
                return [(pick({"en": ["According to ", "For ", "To "], "de": ["Laut ", "Nach ", "Für ", "Wie "], "fr": ["Selon ", "D'après ", "Pour "], "es": ["Según ", "Para "]}[lang]), None), *mention, (pick([", ", " ", ", "]) + (f"{self.copula(lang)} {self.named(lang)}" if lang == "de" and p() < 0.3 else f"{pick(_COPULAS[lang])} {self.named(lang)} {self.adjective(lang)}" if lang == "de" else f"{self.named(lang)} {self.copula(lang)}") + pick([".", ".", ""]), None)]
            tail = pick([" " + pick(_WHEN[lang]), " " + self.clause(lang), " " + self.clause(lang), "", ", " + self.clause(lang), f" {pick(_WORDS[lang][4])} {self.clause(lang)}", f" ({self.clause(lang, 2)})", " " + pick(["about", "on", "zu", "wegen", "sur", "sobre", "über", "pour", "por", "für", "by", "until"]) + " " + pick([self.module(), self.clause(lang, 3), self.number()])])
            end = pick([".", ".", ".", "", ",", "?", "!", ":"])
            if p() < 0.42:
                after = pick(_AFTER[lang])
                lead = pick(["", "", "", "", self.sentence(lang) + " ", pick(_WORDS[lang][5]).capitalize() + " ", "- ", self.clause(lang) + ", " + pick(_WORDS[lang][5]) + " "])
                both = [(pick([" and ", " und ", " et ", " y ", ", "]), None), (self.person(), "person")] if p() < 0.08 else []
                return [(lead, None), *mention, *both, (pick([" ", " ", ", "]) + after + tail + end, None)]
            cue = pick(_BEFORE[lang])
            lead = pick(["", "", "", self.clause(lang) + " ", self.clause(lang) + ", ", self.sentence(lang) + " ", pick(_WORDS[lang][0]).capitalize() + " "])
            cue = cue if lead and lead[-2:] not in (". ", "? ", "! ") else cue[0].upper() + cue[1:] if p() < 0.85 else cue
            both = [(pick([" and ", " und ", " et ", " y ", ", ", " & "]), None), (self.person(), "person")] if p() < 0.12 else []
            return [(lead + cue + pick([" ", " ", " ", " ", ", ", ": "]), None), *mention, *both, (tail + end, None)]
        phrase = pick(_PHRASES[kind][lang]).replace("~", pick([pick(_WORDS[lang][0]), self.module()]))
        left, right = phrase.split("@")
        lead = pick(["", "", "", self.clause(lang) + ", ", self.clause(lang) + " ", self.sentence(lang) + " ", self.module() + ": ", pick(_WORDS[lang][0]).capitalize() + " "])
        if not lead and p() < 0.7:
            left = left[:1].upper() + left[1:]
        tail = pick(["", "", ".", ".", ", " + self.clause(lang) + ".", " " + pick(_WORDS[lang][5]) + " " + self.clause(lang) + ".", "; " + self.clause(lang), ", " + self.clause(lang, 3)])
        if kind == "address" and value.endswith(".") and tail.startswith("."):
            tail = tail[1:]
        return [(lead + left, None), *mention, (right + tail, None)]


def labelled(rows: int = 9000, seed: int = 8) -> list[tuple[str, list[Mention]]]:
    """The table: texts of one line with (start, end, kind) of each mention. Half of the lines begin with none."""
    draw = _Draw(seed)
    out = []
    for k in range(rows):
        lang = draw.pick(["en", "en", "de", "fr", "es"])
        parts = draw.mentioning(lang) if k % 2 else [(draw.plain(lang), None)]
        while draw.chance() < 0.3:  # several sentences on a line
            parts = [*parts, (" ", None), *(draw.mentioning(lang) if draw.chance() < 0.3 else [(draw.sentence(lang), None)])]
        text, found = "", []
        for part, kind in parts:
            if kind:
                found.append((len(text), len(text) + len(part), kind))
            text += part
        out.append((text, found))
    return out

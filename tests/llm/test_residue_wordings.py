from quarrion.llm.residue import is_message, masked

#: Wordings in five languages, none of which the operator holds as a phrase.
HELD_OUT = """This content is not available in your region.
Access denied
Error 502
Please wait while we verify your browser
Your session has timed out. Please sign in again.
An unexpected error has occurred.
Unable to connect to the server
This video is no longer available
Cookies must be enabled to continue
Connection refused by remote host
Invalid API key supplied
You don't have permission to view this file.
Add your caption here
Request blocked by the firewall
Inhalt konnte nicht geladen werden
JavaScript muss aktiviert sein
Zugriff verweigert
Ihre Sitzung ist abgelaufen.
Der Server ist derzeit nicht erreichbar
Hier Text eingeben
Bitte laden Sie die Seite neu
Cette page est introuvable
Une erreur est survenue, veuillez recharger la page
Votre navigateur bloque les cookies.
Accès refusé
Contenu indisponible dans votre pays
Saisissez votre texte
Acceso denegado
La página no existe
Su sesión ha caducado
Se ha producido un error al cargar el archivo
Active las cookies de su navegador
Escriba su texto
Acesso negado
O conteúdo não está disponível na sua região
Ocorreu um erro ao carregar a legenda
Sua sessão expirou
Digite o texto aqui
The requested URL was rejected.
Our servers are currently overloaded, please retry in a few minutes.
403 Forbidden
Page expired
Something broke while loading captions
No captions available for this video
The download link has expired.
Please disable your ad blocker to continue
Your browser is not supported
Insert subtitle here
[subtitle missing]
Unhandled exception at 0x7ff: access violation
ValueError: invalid literal for int()
Ihr Browser unterstützt dieses Video nicht
Die Seite wurde nicht gefunden
Zeitüberschreitung der Anfrage
Datenbankfehler: Verbindung verloren
Text hier einfügen
Bitte melden Sie sich an, um fortzufahren
Le serveur ne répond pas
Fichier non trouvé
Votre session a expiré, reconnectez-vous.
Insérez le sous-titre ici
Service temporairement indisponible
El servidor no responde
Archivo no encontrado
Demasiadas solicitudes, espere un momento.
Inserte el subtítulo aquí
No se pudo cargar el vídeo
Erro interno do servidor
Arquivo não encontrado
Muitas solicitações. Aguarde.
Insira a legenda aqui
Não foi possível carregar o vídeo
Habilite os cookies para continuar
Gateway timeout
The file you requested has been moved.
Subscription required to view this content
Too many login attempts, try again later
The page isn't redirecting properly
Our site uses cookies. Accept to continue.
Segmentation fault (core dumped)
Warning: mysql_connect() failed on line 12
Null pointer exception in module subs
Subtitle text goes here
Untertitel werden geladen
Diese Seite existiert nicht
Ungültiger Schlüssel für den Dienst
Die Verbindung zum Server wurde unterbrochen
Bitte aktualisieren Sie Ihren Browser
Untertitel hier eingeben
Impossible de charger la vidéo
Mot de passe invalide
Trop de requêtes, réessayez plus tard
Activez JavaScript dans votre navigateur
Texte du sous-titre ici
Página en mantenimiento
Error interno del servidor
El enlace ha caducado
Active JavaScript para ver esta página
Texto del subtítulo aquí
Conexão perdida. Tente novamente.
Página indisponível no momento
Este vídeo foi removido
Ative o JavaScript para continuar
Texto da legenda aqui
Unable to process your request
Invalid credentials
This account has been suspended
Preview not available for this file
Browser update needed
Runtime error 91
The operation timed out
Proxy authentication required
Enter subtitle text
Kein Zugriff auf diese Datei
Die Datei ist beschädigt
Bitte Cookies aktivieren
Fehler 404
Platzhaltertext für Untertitel
La connexion a échoué
Cette vidéo n'est plus disponible
Erreur 500
Veuillez patienter pendant le chargement
Acceso bloqueado
Error al conectar con la base de datos
El archivo está dañado
Texto pendiente de traducción
Falha ao carregar o arquivo
Senha inválida
Erro 503
Aguarde enquanto verificamos o seu navegador""".split("\n")
SPEECH = """Nobody found the page where she wrote it.
Turn to page nine and read.
The service was terrible tonight.
Please wait for the captain at the gate.
The connection between them was broken.
Access to the tower is blocked by snow.
You have to enable JavaScript first, my nephew told me.
Error 404 again. The intern pulled the plug.
Access denied? To my own vault?
An error occurred, Captain. A human one.
The page said 404, Ysolde. Four-oh-four. Not found.
The server is down again, Velka.
It’s undefined, professor. Divide by zero, you get nothing.
Please wait. Loading... the cannon, I mean.
And the letter began 'insert name here'.
Download the app: capharbor.example/app
Subtitles shared on www.capharbor.example
They printed lorem ipsum on every brochure!
Bitte, warte auf mich.
Die Verbindung nach Karvath ist gesperrt, sagt Petra.
Por favor, espere un momento en la estación.
Il faut verser de l'eau ici.
The video of the wedding was lost.
Add your name here and sign.
Not for sale.""".split("\n")


def test_held_out_wordings():
    found = [t for t in HELD_OUT if is_message(masked(t))]
    assert len(HELD_OUT) >= 30 and len(found) >= 0.9 * len(HELD_OUT), sorted(set(HELD_OUT) - set(found))


def test_speech_that_mentions_such_things():
    assert not [t for t in SPEECH if is_message(masked(t))]


def test_verdict_is_local():
    """Long texts are judged by neighbouring sentences, so far-apart words do not add up."""
    assert not is_message("The page was white. " + "Snow fell over the harbor and the boats lay still. " * 200 + "The bridge was blocked.")
    assert is_message("Snow fell over the harbor. " * 100 + "This page could not be found on the server.")


#: Wordings written after the vocabulary and never used to extend it.
FRESH = """Sorry, this title is currently unavailable
Subtitles could not be downloaded
Please update your browser to the latest version
Network connection lost
Playback error. Please refresh the page.
The link you followed is broken
Authentication failed
Missing translation for key intro
Lyrics placeholder
Verbindung zum Server verloren
Diese Datei ist nicht verfügbar
Laden der Untertitel fehlgeschlagen
Bitte warten, Seite wird geladen
Ungültiges Passwort
Page non trouvée
Le lien a expiré
Le téléchargement a échoué
Veuillez vous connecter pour continuer
Contraseña incorrecta
El navegador no es compatible
No hay subtítulos disponibles
Vuelva a cargar la página
O servidor não está respondendo
Ative os cookies no seu navegador
Link expirado
Carregando legendas""".split("\n")


def test_fresh_wordings():
    """A plain measure of what lies outside the vocabulary: about two in three are found."""
    assert sum(is_message(masked(t)) for t in FRESH) >= 0.6 * len(FRESH)

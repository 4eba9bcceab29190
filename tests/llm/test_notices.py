"""Messages of real servers, frameworks and site builders that the tables were not made from."""

import pytest

from weftlight.llm import notices
from weftlight.llm.linekinds import normal, seen

ERRORS = """
404 Not Found
Page not found
403 Forbidden
500 Internal Server Error
502 Bad Gateway
503 Service Unavailable
504 Gateway Time-out
HTTP Error 404.0 - Not Found
Oops! That page can’t be found.
Sorry, this page isn't available.
The requested URL /index.html was not found on this server.
The resource cannot be found.
You don't have permission to access this resource.
Whoops, looks like something went wrong.
An unexpected error has occurred.
There has been a critical error on this website.
Error establishing a database connection
Briefly unavailable for scheduled maintenance. Check back in a minute.
This site can’t be reached
Server Error in '/' Application.
Notice: Undefined index: id in /var/www/html/index.php on line 12
Warning: mysqli_connect(): (HY000/1045): Access denied for user
Exception in thread "main" java.lang.NullPointerException
Seite nicht gefunden
Die angeforderte Seite wurde nicht gefunden.
Page introuvable
Erreur 404 : la page n'existe pas
Página no encontrada
Página não encontrada
Pagina niet gevonden
Deze pagina bestaat niet
Страница не найдена
Ошибка 404. Страница не существует
الصفحة غير موجودة
पृष्ठ नहीं मिला
ページが見つかりません
ページが見つかりませんでした
页面不存在
抱歉，您访问的页面不存在
ไม่พบหน้านี้
"""

SCRIPTS = """
You need to enable JavaScript to run this app.
JavaScript is disabled in your browser. Please enable it to proceed.
Please turn JavaScript on and reload the page.
Enable JavaScript and cookies to continue
This website requires JavaScript.
Checking if the site connection is secure
Verifying you are human. This may take a few seconds.
Bitte aktiviere JavaScript, um fortzufahren.
Vous devez activer JavaScript pour utiliser cette application.
Necesitas habilitar JavaScript para ejecutar esta aplicación.
Você precisa habilitar o JavaScript para executar este aplicativo.
Schakel JavaScript in om deze website te bekijken.
Для работы этого сайта необходимо включить JavaScript.
JavaScriptを有効にしてください。
请启用JavaScript。
"""

FILLERS = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Sed ut labore et dolore magna aliqua, quis nostrud exercitation ullamco.
Hello world! Welcome to WordPress. This is your first post. Edit or delete it, then start writing!
This is a sample text.
Add your text here
I am a text block. Click edit button to change this text.
This is an example page. It’s different from a blog post.
Hier steht Ihr Text
Ajoutez votre texte ici
Escriba su texto aquí
Введите текст здесь
ここにテキストを入力してください
在此输入文字
"""

#: Sentences that mention such things, and plain ones.
HONEST = """
The mill near Karruth was moved because the orchard needed more room, and nobody asked why.
A query without an index is slower than most visitors expect, even where the server is fast.
She wrote the first letter to the editor of the review on a wet afternoon in October.
Der alte Speicher steht seit dem letzten Winter leer, und niemand hat bisher gefragt, warum.
La maison près du pont a été vendue deux fois avant que le moulin soit enfin réparé.
昨年の冬、橋の近くの庭園にはほとんど近づけませんでした。
"""


def lines(text):
    return [line for line in text.strip().split("\n") if line]


@pytest.mark.parametrize(("kind", "text"), [("error", ERRORS), ("script", SCRIPTS), ("filler", FILLERS)])
def test_held_out_messages(kind, text):
    found = [seen(line).notice == kind for line in lines(text)]
    print(kind, sum(found), "of", len(found), [x for x, f in zip(lines(text), found, strict=True) if not f])
    assert sum(found) >= 0.8 * len(found)


def test_honest_sentences_are_no_notices():
    assert [x for x in lines(HONEST) if seen(x).notice] == []


def test_automaton_against_plain_search():
    """Whole entries, and pairs of one language, by searching for each entry."""
    plain = notices.entries()
    for line in lines(ERRORS + SCRIPTS + FILLERS + HONEST):
        text = normal(line).replace("’", "'")
        hits = {}
        for kind, part, language, phrase in plain:
            at = text.find(phrase)
            while at >= 0:
                before = text[at - 1] if at else " "
                bound = phrase[0].isalpha() and not notices._SPACELESS.match(phrase)
                if not (bound and before.isalnum() and not notices._SPACELESS.match(before)):
                    hits.setdefault((kind, language), {}).setdefault(part, set()).update(range(at, at + len(phrase)))
                at = text.find(phrase, at + 1)
        expected = {}
        for (kind, _), parts in hits.items():
            taken = set(parts.get(notices.WHOLE, ()))
            if notices.SUBJECT in parts and notices.PREDICATE in parts:
                taken |= parts[notices.SUBJECT] | parts[notices.PREDICATE]
            expected[kind] = expected.get(kind, set()) | taken
        assert notices.covered(text) == {k: len(v) for k, v in expected.items() if v}, line

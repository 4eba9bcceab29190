"""Phrases that stand in place of content: errors, script notices, filler text.

The tables are fixed values: what web servers, gateways, programming languages,
frameworks, site builders and themes print, in the twelve languages of the
language table. An entry is a phrase that tells by itself, or a subject and a
predicate that tell together ("page" and "not found"), so that wordings need not
be listed one by one. Entries are lower case; a multi-pattern automaton finds all
of them in one pass over a text.
"""

from __future__ import annotations

from functools import cache

import ahocorasick
import regex

# Error messages that tell by themselves.
ERRORS = """
en not found; forbidden; access denied; access is denied; permission denied; do not have permission; don't have permission; not authorized; unauthorized; bad gateway; bad request; gateway time
en internal server error; internal error; something went wrong; an error occurred; an error has occurred; unexpected error; critical error; application error; error establishing a database connection
en too many requests; rate limit exceeded; temporarily unavailable; service unavailable; try again later; try again in; please try again; slow down; under maintenance; carry out maintenance; down for maintenance
en error code; reference code; request id; ray id; connection refused; connection timed out; this site can't be reached; no longer available; no longer exists; an exception
es acceso denegado; acceso prohibido; no tiene permiso; error interno; algo salió mal; se ha producido un error; ha ocurrido un error; inténtelo más tarde; inténtalo más tarde; inténtelo de nuevo; demasiadas solicitudes
de zugriff verweigert; zugriff nicht erlaubt; keine berechtigung; fehlt die berechtigung; serverfehler; interner fehler; ein fehler ist aufgetreten; etwas ist schiefgelaufen; versuchen sie es später; zu viele anfragen
fr accès refusé; accès interdit; erreur interne; une erreur est survenue; une erreur s'est produite; réessayer plus tard; droits nécessaires; n'avez pas les droits; n'êtes pas autorisé; trop de requêtes
pt acesso negado; acesso proibido; não tem permissão; erro interno; ocorreu um erro; algo deu errado; algo correu mal; tente mais tarde; tente novamente; muitas solicitações
nl geen toegang; toegang geweigerd; geen rechten; geen toestemming; interne serverfout; er is een fout opgetreden; er ging iets mis; er is iets misgegaan; probeer het later; te veel verzoeken
ru доступ запрещён; доступ запрещен; нет прав; недостаточно прав; внутренняя ошибка; произошла ошибка; что-то пошло не так; попробуйте позже; повторите попытку; слишком много запросов
ar تم رفض الوصول; الوصول مرفوض; ليس لديك إذن; ليست لديك صلاحية; خطأ داخلي; حدث خطأ; حاول لاحقا; حاول مرة أخرى; يرجى المحاولة
hi पहुँच अस्वीकृत; अनुमति नहीं; आंतरिक त्रुटि; सर्वर त्रुटि; त्रुटि हुई; कुछ गलत हो गया; बाद में फिर; पुनः प्रयास
ja アクセスが拒否; アクセス権; 権限がありません; 内部エラー; サーバーエラー; エラーが発生; エラーが起き; もう一度お試し; 後でもう一度; しばらくしてから
zh 拒绝访问; 访问被拒绝; 没有权限; 无权访问; 内部错误; 服务器错误; 发生错误; 出错了; 稍后再试; 请稍后; 重试; 请求过多
th ปฏิเสธการเข้าถึง; ไม่มีสิทธิ์; ข้อผิดพลาดภายใน; เกิดข้อผิดพลาด; ลองใหม่; ลองอีกครั้ง; ภายหลัง
"""

# What failing programs print.
FAILURES = """
fatal error; parse error; syntax error; uncaught; unhandled; stack trace; traceback (most recent call last); thrown in; on line; cannot modify header information; output started at; headers already sent
undefined index; undefined variable; undefined offset; allowed memory size; memory exhausted; exhausted at; out of memory; segmentation fault; core dumped; nullpointerexception; null pointer; exception in thread
java.lang.; java.io.; java.util.; at java.; at org.; at com.; at app.; caused by:; nested exception; system.web.; asp.net; mysql_connect; mysqli; sqlstate; sql syntax; query failed; ora-0; relation
typeerror; valueerror; keyerror; referenceerror; syntaxerror; runtimeerror; is not defined; is not a function; cannot read propert; module not found; no such file or directory; failed to open stream; /var/www/; /srv/; /usr/lib/; .php:; .php on; .py", line; .js:; .rb:; .jsp
"""

# Subjects of error messages.
ERROR_SUBJECTS = """
en page; site; website; file; document; resource; service; server; link; address; url; request; article; content
es página; sitio; archivo; documento; recurso; servicio; servidor; enlace; dirección
de seite; datei; dokument; dienst; server; ressource; adresse; inhalt; link
fr page; fichier; document; ressource; service; serveur; lien; adresse; site
pt página; arquivo; ficheiro; documento; recurso; serviço; servidor; endereço; ligação; site
nl pagina; bestand; document; bron; dienst; server; adres; link; website
ru страниц; файл; документ; ресурс; сервис; сервер; адрес; ссылк; сайт
ar الصفحة; الملف; المورد; الخدمة; الخادم; الرابط; الموقع
hi पृष्ठ; पेज; फ़ाइल; सेवा; सर्वर; साइट; लिंक
ja ページ; ファイル; サービス; サーバー; サイト; リソース
zh 页面; 网页; 您要的页; 文件; 服务; 服务器; 网站; 资源; 链接
th หน้า; ไฟล์; บริการ; เซิร์ฟเวอร์; เว็บไซต์; ลิงก์
"""

# Predicates of error messages.
ERROR_PREDICATES = """
en could not be found; cannot be found; can't be found; couldn't find; was not found; does not exist; doesn't exist; may be broken; is broken; was removed; has been removed; been moved; is unavailable; is not available; is down; failed; expired; maintenance
es no encontrad; no se encontró; no se ha encontrado; no se encuentra; no existe; no disponible; no está disponible; mantenimiento; solicitad
de nicht gefunden; nicht vorhanden; existiert nicht; nicht erreichbar; nicht verfügbar; wartung; gesuchte; angeforderte
fr introuvable; n'existe pas; n'existe plus; non trouvé; pas été trouvé; indisponible; maintenance; demandé
pt não encontrad; não foi encontrad; não existe; indisponível; não disponível; manutenção; pedida; solicitad
nl niet gevonden; bestaat niet; niet beschikbaar; onbereikbaar; onderhoud; gevraagde; opgevraagde
ru не найден; не существует; недоступн; обслуживан; запрошенн
ar غير موجود; غير متاح; لم يتم العثور; تعذر العثور; غير متوفر; صيانة; المطلوب
hi नहीं मिला; नहीं मिली; मौजूद नहीं; उपलब्ध नहीं; त्रुटि; रखरखाव
ja 見つかりません; 見つかりませんでした; 存在しません; 利用できません; メンテナンス; お探しの
zh 找不到; 未找到; 不存在; 无法访问; 不可用; 维护; 无法找到
th ไม่พบ; ไม่มีอยู่; ไม่พร้อมใช้งาน; ขัดข้อง; ปิดปรับปรุง; ที่คุณต้องการ
"""

# Notices about scripts and checks that tell by themselves.
SCRIPTS = """
en checking your browser; verify you are human; verifying you are human; are you a robot; i'm not a robot; just a moment; this may take a moment; may take a few seconds; security check; does not run scripts; does not support scripts; redirected automatically
es compruebe que es humano; comprobando su navegador
de browser wird überprüft; überprüfen sie, dass sie ein mensch sind
fr vérification de votre navigateur; vérifiez que vous êtes humain
pt verificando o seu navegador; verifique que é humano
nl uw browser wordt gecontroleerd
ru проверка браузера; подтвердите, что вы не робот
ja ブラウザを確認しています
zh 正在检查您的浏览器; 验证您是真人
"""

# What such notices are about.
SCRIPT_SUBJECTS = """
en javascript; scripts; scripting; cookies
es javascript; scripts
de javascript; skripte
fr javascript; scripts
pt javascript; scripts
nl javascript; scripts
ru javascript; скрипт
ar جافا سكريبت; جافاسكريبت; javascript
hi जावास्क्रिप्ट; javascript; स्क्रिप्ट
ja javascript; スクリプト
zh javascript; 脚本
th javascript; จาวาสคริปต์; สคริปต์
"""

# What such notices ask for.
SCRIPT_PREDICATES = """
en enable; turn on; activate; switch on; allow; disabled; turned off; required; requires; needs; need; without; to run this app; to view this
es active; activar; active el; habilite; habilitar; active javascript; necesita; requiere; desactivado
de aktivieren; einschalten; aktiviert; deaktiviert; benötigt; erforderlich; ohne
fr activer; activez; activé; désactivé; nécessaire; nécessite; sans
pt ative; ativar; habilite; desativado; necessário; requer; sem
nl zet; inschakelen; schakel; aanzetten; uitgeschakeld; vereist; nodig; zonder
ru включите; включить; отключен; требуется; необходим; без
ar تفعيل; تمكين; فعّل; معطل; يتطلب
hi चालू करें; सक्षम करें; सक्रिय करें; आवश्यक; अक्षम
ja 有効; オンに; 無効; 必要
zh 启用; 开启; 打开; 禁用; 需要
th เปิดใช้งาน; เปิดการใช้งาน; ปิดใช้งาน; จำเป็น
"""

# The forms in which template languages write a field.
FIELD = regex.compile(
    r"\{\{[^{}\n]+\}\}|\$\{[^{}\n]+\}|<%[^%\n]+%>|\{%[^%\n]+%\}|#\{[^{}\n]+\}|\[\[[^\[\]\n]+\]\]|@@[\w.\- ]+@@"
    r"|__[A-Za-z][\w.]*?__|%[A-Za-z_][\w.]*%|%\([\w.]+\)[sd]|\[insert [^\[\]\n]+\]|&lt;[A-Za-z_][\w.]*&gt;"
)
FIELD_MARKS = ("{{", "${", "<%", "{%", "#{", "[[", "@@", "__", "%", "[insert", "&lt;")
# Filler text of site builders and themes, and the name of the classic dummy text.
FILLERS = """
en lorem ipsum; text goes here; your text here; your content here; content goes here; title goes here; headline goes here; headline here; insert text; insert your text; insert headline; insert two; add your text; add text here; type your text
en replace this text; replace this paragraph; replace this with; body copy; placeholder text; dummy text; sample text; sample page; example page; edit or delete it; start writing; click here to edit; click to edit; this is your first post; welcome to wordpress
es su texto aquí; su texto va aquí; tu texto aquí; inserte texto; inserte su texto; escriba su texto; texto de ejemplo; texto de relleno; sustituya este; reemplace este; página de ejemplo
de ihr text; ihren text; hier steht text; text hier einfügen; beispieltext; blindtext; platzhaltertext; beispielseite; ersetzen sie diesen; bearbeiten oder löschen; bitte bearbeiten
fr votre texte; texte d'exemple; faux texte; remplacez ce; page d'exemple; insérez du texte; cliquez pour modifier
pt seu texto aqui; texto aqui; insira o seu texto; insira seu texto; texto de exemplo; substitua este; página de exemplo
nl uw tekst; jouw tekst; voorbeeldtekst; voorbeeldpagina; vervang deze; plaats hier; klik om te bewerken
ru ваш текст; введите текст; вставьте текст; пример текста; пример страницы; замените этот; здесь будет текст
ar نصك هنا; ضع النص هنا; أدخل النص; نص تجريبي; نص افتراضي; استبدل هذه; استبدل هذا; استبدل النص
hi आपका पाठ; अपना पाठ; नमूना पाठ; अपना टेक्स्ट; अनुच्छेद को बदलें; टेक्स्ट को बदलें
ja ここに文章; ここにテキスト; 文章が入ります; テキストが入ります; ダミーテキスト; サンプルテキスト; サンプルページ; 置き換えてください
zh 您的文字; 您的文本; 在此输入; 在这里输入; 请替换; 示例文字; 示例文本; 示例页面; 占位文字
th ข้อความของคุณ; ใส่ข้อความ; พิมพ์ข้อความ; ข้อความตัวอย่าง; หน้าตัวอย่าง; โปรดแทนที่
"""

# The classic dummy text. Generators cut, mix and alter its words.
CLASSIC = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
"""
#: First letters by which an altered word of the classic dummy text is known, and the share of a text's words that must be known.
ALTERED, FILLER_SHARE = 3, 0.7
_BEGINNINGS = frozenset(w[:ALTERED] for w in CLASSIC.split() if len(w) >= ALTERED)

WHOLE, SUBJECT, PREDICATE = range(3)
TABLES = (
    ("error", WHOLE, ERRORS), ("error", WHOLE, FAILURES), ("error", SUBJECT, ERROR_SUBJECTS), ("error", PREDICATE, ERROR_PREDICATES),
    ("script", WHOLE, SCRIPTS), ("script", SUBJECT, SCRIPT_SUBJECTS), ("script", PREDICATE, SCRIPT_PREDICATES), ("filler", WHOLE, FILLERS),
)
LANGUAGES = frozenset("en es de fr pt nl ru ar hi ja zh th".split())
#: Share of a sentence's characters that entries must cover for it to be a notice.
SENTENCE_COVERED = 0.2
#: Share of a line's characters that lie in such sentences for the line to be one: what to do and a reference often stand beside the message.
LINE_COVERED = 0.33

_SENTENCE = regex.compile(r"(?<=[.!?।])\s+|(?<=[。！？])\s*")
_SPACELESS = regex.compile(r"[\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}]")


def entries() -> list[tuple[str, int, str, str]]:
    """(kind, part, language, phrase) of all tables; failures have no language."""
    out = []
    for kind, part, text in TABLES:
        for line in text.strip().split("\n"):
            first, _, rest = line.partition(" ")
            language, listed = (first, rest) if first in LANGUAGES else ("", line)
            out.extend((kind, part, language, phrase.strip()) for phrase in listed.split(";") if phrase.strip())
    return out


@cache
def automaton() -> ahocorasick.Automaton:
    """One automaton of all entries; a value is (length, whether it begins at a word, its meanings)."""
    meanings: dict[str, list[tuple[str, int, str]]] = {}
    for kind, part, language, phrase in entries():
        meanings.setdefault(phrase, []).append((kind, part, language))
    made = ahocorasick.Automaton()
    for phrase, meant in meanings.items():
        made.add_word(phrase, (len(phrase), phrase[0].isalpha() and not _SPACELESS.match(phrase), meant))
    made.make_automaton()
    return made


def _hits(text: str) -> list[tuple[int, int, list[tuple[str, int, str]]]]:
    """(start, end, meanings) of the entries in a text."""
    out = []
    for end, (length, at_word, meant) in automaton().iter(text):
        start = end + 1 - length
        before = text[start - 1] if start else " "
        if not (at_word and before.isalnum() and not _SPACELESS.match(before)):
            out.append((start, end + 1, meant))
    return out


def _telling(hits: list[tuple[int, int, list[tuple[str, int, str]]]]) -> dict[tuple[str, str], set[int]]:
    """The parts that stand in a text, by kind and language; empty if none of them tells, alone or together."""
    parts: dict[tuple[str, str], set[int]] = {}
    tells = False
    for _, _, meant in hits:
        for kind, part, language in meant:
            found = parts.setdefault((kind, language), set())
            found.add(part)
            tells = tells or part == WHOLE or len(found - {WHOLE}) == 2
    return parts if tells else {}


def covered(sentence: str) -> dict[str, int]:
    """Characters of a sentence (lower case, single spaces) that entries of each kind cover.

    Subjects and predicates count where both stand in the sentence, in one language.
    """
    hits = _hits(sentence)
    parts = _telling(hits)
    found: dict[str, int] = {}
    if not parts:
        return found
    reach: dict[str, int] = {}
    for start, end, meant in sorted(hits, key=lambda h: h[:2]):
        for kind in {kind for kind, part, language in meant if part == WHOLE or parts[kind, language] >= {SUBJECT, PREDICATE}}:
            new = end - max(start, reach.get(kind, 0))
            if new > 0:
                found[kind] = found.get(kind, 0) + new
                reach[kind] = end
    return found


def dummy_words(words: list[str]) -> bool:
    """Whether words, lower case, are the classic dummy text, or cut, mixed and altered from it."""
    return len(words) >= 3 and sum(w[:ALTERED] in _BEGINNINGS for w in words) >= FILLER_SHARE * len(words)


def notice_of(text: str) -> tuple[str, int]:
    """The kind of notice that a text (lower case, single spaces) is, and the characters of its matched sentences.

    The kind is error, script or filler, or "" if it is none.
    """
    text = text.replace("’", "'")
    matched: dict[str, int] = {}
    whole = 0
    if not _telling(_hits(text)):
        return "", 0
    for sentence in _SENTENCE.split(text):
        size = len(sentence)
        whole += size
        found = covered(sentence)
        if found:
            kind = max(found, key=lambda k: (found[k], k))
            if found[kind] >= SENTENCE_COVERED * size:
                matched[kind] = matched.get(kind, 0) + size
    total = sum(matched.values())
    if not matched or total < LINE_COVERED * whole:
        return "", 0
    return max(matched, key=lambda k: (matched[k], k)), total

"""Made-up texts from which the models of problem 10 are fitted: what each kind of residue says, and what merely speaks of it.

They are written from general knowledge of web pages, forms and program
messages, not taken from any corpus that is judged. A line is a sentence.
"""

#: Stand-in text.
FILLER = """Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.
Placeholder text.
This is placeholder text.
This is dummy text and will be replaced.
This text is a placeholder for the final text.
This sentence is a stand-in until the final wording arrives.
Stand-in copy, to be replaced before printing.
Sample text.
Sample text for this section.
Sample heading, sample paragraph, sample caption.
Dummy text, dummy heading, dummy item one, dummy item two.
Dummy entry for testing.
Example entry one, example entry two, example entry three.
Your text here.
Your text goes here.
Your headline goes here.
Add your text here.
Type your text here.
Enter your content here.
Content goes here.
The content of this section will appear here.
Your description will appear in this box.
Title goes here.
Subtitle goes here.
Image caption goes here.
Insert text here.
Insert a brief introduction here.
Insert a summary of the chapter.
Write a short description of the product.
Text to come.
Copy to come.
Details to follow.
More text to follow.
To be added.
To be written.
To be written by the author.
To be completed by the editor.
To be supplied later.
Coming soon.
Coming soon: more content.
Description coming soon.
Content coming soon.
The final text will be added later.
Final copy to be supplied.
Draft copy only, replace before release.
Replace this paragraph with your own words.
Blah blah blah.
Filler filler filler.
Ici votre texte.
Texte à venir.
Votre texte ici.
Texte provisoire, à remplacer.
Ceci est un faux texte.
Le texte définitif sera ajouté plus tard.
Le contenu définitif apparaîtra ici.
Titre à compléter.
Description à venir.
Hier steht Ihr Text.
Hier kommt später der Text hin.
Dies ist ein Blindtext.
Blindtext, wird noch ersetzt.
Platzhaltertext für diesen Abschnitt.
Text folgt.
Der endgültige Text folgt später.
Beschreibung folgt in Kürze.
Aquí va su texto.
Su texto aquí.
Texto de ejemplo.
Texto provisional, se sustituirá más adelante.
El texto final irá aquí.
Aquí aparecerá el contenido.
Contenido pendiente.
Descripción pendiente de redactar.
Seu texto aqui.
O texto entra aqui.
Texto provisório, a ser substituído.
O conteúdo final aparecerá aqui.
Descrição em breve.
Teks contoh.
Teks Anda di sini.
Teks sementara, akan diganti.
Isi akan ditambahkan kemudian.
Deskripsi menyusul.
Здесь будет ваш текст.
Текст-заполнитель.
Временный текст, будет заменён.
Описание появится позже.
Окончательный текст появится здесь.
此处输入文字。
此处为占位文字。
内容待补充。
正式文案稍后提供。
请在此处填写说明。
ここにテキストが入ります。
ダミーテキストです。
仮のテキストです。後で差し替えます。
本文は準備中です。
正式な文章が入ります。
ใส่ข้อความของคุณที่นี่
ข้อความตัวอย่าง
ข้อความจริงจะใส่ภายหลัง
เนื้อหาจะตามมา
ဤနေရာတွင် သင့်စာသားကို ထည့်ပါ။
နမူနာ စာသား။
စာသားအမှန် နောက်မှ ထည့်မည်။
ယာယီ စာသား ဖြစ်သည်။"""

#: Error pages and program messages.
ERROR = """400 Bad Request
401 Unauthorized
403 Forbidden
404 Not Found
405 Method Not Allowed
408 Request Timeout
410 Gone
413 Payload Too Large
429 Too Many Requests
500 Internal Server Error
501 Not Implemented
502 Bad Gateway
503 Service Unavailable
504 Gateway Timeout
Gateway timeout
Error 404: page not found.
Error 500: internal server error.
Error code 503.
HTTP error 404.
Page not found.
File not found.
Not found
Oops! That page can’t be found.
The requested URL was not found on this server.
The page you are looking for does not exist.
The address you entered does not exist.
The page you requested could not be found.
The requested resource could not be found.
The requested page has been removed or is no longer available.
This video has been removed by its owner.
This link has expired.
The file you requested is no longer available.
This item is no longer available or was deleted.
No results found.
Your search returned no results.
Internal server error.
The server encountered an internal error and was unable to complete your request.
The server did not respond in time.
The server took too long to answer.
The service is temporarily unavailable.
The service is currently unavailable.
This site is down for maintenance.
We are performing scheduled maintenance.
Please try again later.
Please try again in a few minutes.
Something went wrong.
Something went wrong on our end.
Oops, something went wrong.
An unexpected error has occurred.
An error occurred while processing your request.
Reload the page and try again.
Refresh the page to continue.
Access denied.
Access to this page is forbidden.
You do not have permission to access this resource.
You do not have permission to view this page.
You don’t have permission to open this file.
You must be signed in to see this page.
Please sign in again.
Your session has expired.
Your session timed out, please log in again.
Could not connect to the database.
Could not connect to the server (error 2002).
Unable to establish a database connection.
The connection has timed out.
The connection was reset.
This site can’t be reached.
Too many requests.
Request limit exceeded.
Quota exceeded.
Reference number 7f3a9c2e.
Request id: 9b1deb4d.
Incident id 1c9e4a.
Traceback (most recent call last):
File "/srv/app/main.py", line 48, in run
File "server.py", line 7, in handle
ValueError: invalid literal for int()
KeyError: 'user'
IndexError: list index out of range
AttributeError: object has no attribute
RuntimeError: out of memory
java.lang.NullPointerException
java.lang.IllegalArgumentException: bad value
java.lang.IllegalStateException: stream closed
at com.example.app.Main.run(Main.java:17)
Exception in thread "main" java.lang.RuntimeException
Caused by: java.io.IOException: no such file
Fatal error: Uncaught Error: Call to undefined function
Uncaught TypeError: Cannot read properties of undefined
Segmentation fault (core dumped)
{"error":{"code":500,"message":"internal error"}}
{"error":{"code":403,"message":"rate limit exceeded","status":"denied"}}
{"error":{"type":"invalid_request","message":"missing field"}}
{"status":404,"error":"not found","path":"/api"}
{"message":"unauthorized","request_id":"ab12cd34"}
<error><code>404</code><message>not found</message></error>
Erreur 404 : page non trouvée.
Page introuvable.
La page que vous cherchez n’existe pas.
Accès refusé.
Vous n’avez pas l’autorisation d’ouvrir cette page.
Votre session est expirée, reconnectez-vous.
Le service est temporairement indisponible.
Une erreur inattendue s’est produite, réessayez plus tard.
Fehler 404: Seite nicht gefunden.
Die angeforderte Seite wurde nicht gefunden.
Zugriff verweigert.
Sie haben keine Berechtigung, diese Seite zu öffnen.
Ihre Sitzung ist abgelaufen, bitte erneut anmelden.
Bitte melden Sie sich erneut an.
Der Dienst ist vorübergehend nicht verfügbar.
Der Server ist derzeit nicht erreichbar.
Es ist ein unerwarteter Fehler aufgetreten, bitte später erneut versuchen.
Error 404: no se encontró la página.
Página no encontrada.
La página que busca no existe.
Acceso denegado.
No tiene permiso para abrir esta página.
Su sesión ha expirado, inicie sesión de nuevo.
El servicio no está disponible en este momento.
Se produjo un error inesperado, vuelva a intentarlo más tarde.
Erro 404: página não encontrada.
A página que você procura não existe.
Acesso negado.
Sua sessão expirou, entre novamente.
O serviço está temporariamente indisponível.
Ocorreu um erro inesperado, tente novamente mais tarde.
Kesalahan 404: halaman tidak ditemukan.
Akses ditolak.
Sesi Anda telah berakhir, silakan masuk lagi.
Layanan sedang tidak tersedia.
Terjadi kesalahan, silakan coba lagi nanti.
Ошибка 404: страница не найдена.
Доступ запрещён.
Ваша сессия истекла, войдите снова.
Сервис временно недоступен.
Произошла ошибка, повторите попытку позже.
错误 404：找不到该页面。
您访问的页面不存在。
拒绝访问。
会话已过期，请重新登录。
服务暂时不可用。
发生错误，请稍后再试。
エラー 404：ページが見つかりません。
お探しのページは存在しません。
アクセスが拒否されました。
セッションの有効期限が切れました。もう一度ログインしてください。
サービスは現在利用できません。
エラーが発生しました。しばらくしてからもう一度お試しください。
ข้อผิดพลาด 404: ไม่พบหน้าที่ต้องการ
การเข้าถึงถูกปฏิเสธ
เซสชันหมดอายุ โปรดเข้าสู่ระบบอีกครั้ง
บริการไม่พร้อมใช้งานชั่วคราว
เกิดข้อผิดพลาด โปรดลองอีกครั้งภายหลัง
အမှား 404: စာမျက်နှာ ရှာမတွေ့ပါ။
ဝင်ရောက်ခွင့် မရှိပါ။
ဝန်ဆောင်မှု ခေတ္တ ရပ်ဆိုင်းထားသည်။
အမှားတစ်ခု ဖြစ်ပွားသည်။ နောက်မှ ထပ်ကြိုးစားပါ။"""

#: Notices that scripts or cookies are required.
NOTICE = """You need to enable JavaScript to run this app.
Please enable JavaScript to continue.
Please enable JavaScript in your browser.
Please turn on JavaScript and reload the page.
JavaScript is required to use this site.
JavaScript is disabled in your browser.
JavaScript seems to be disabled.
JavaScript must be turned on.
This site requires JavaScript.
This page requires JavaScript to work.
This application needs JavaScript to run.
This page only works with JavaScript enabled.
This viewer does not work without JavaScript.
The app cannot start without scripts.
Your browser does not support JavaScript.
Your browser does not support scripts, so the page cannot be shown.
Your browser has scripting turned off.
Scripting is turned off, turn it on to see this content.
Allow scripts to load this page.
Allow scripts and cookies for this site.
Scripts are blocked, please permit them and reload.
Please allow cookies to continue.
Cookies must be enabled.
This site needs cookies and scripts.
Sorry, this page doesn’t work properly without JavaScript enabled.
Sorry, JS is required.
Enable JS and disable any ad blocker.
Checking your browser before accessing the site.
Checking if the connection is secure.
We are verifying that you are human before you can proceed.
This process is automatic, your browser will redirect shortly.
Loading, please wait.
If this page does not load, check that JavaScript is enabled.
If nothing appears, check that scripts are allowed.
noscript
Veuillez activer JavaScript dans votre navigateur.
JavaScript est nécessaire pour afficher cette page.
JavaScript est désactivé.
Ce site nécessite JavaScript.
Cette application a besoin des scripts du navigateur.
Autorisez les scripts et les cookies.
Votre navigateur bloque les scripts.
Bitte aktivieren Sie JavaScript in Ihrem Browser.
JavaScript ist deaktiviert.
Diese Seite funktioniert nur mit JavaScript.
Diese Anwendung benötigt JavaScript.
Erlauben Sie Skripte und Cookies.
Ihr Browser blockiert Skripte.
Active JavaScript en su navegador.
Habilite JavaScript para ver esta página.
JavaScript está desactivado.
Este sitio requiere JavaScript.
Esta aplicación necesita los scripts del navegador.
Permita los scripts y las cookies.
Ative o JavaScript no seu navegador.
Habilite o JavaScript para ver esta página.
Este site requer JavaScript.
Este aplicativo precisa de scripts.
Aktifkan JavaScript di peramban Anda.
Situs ini memerlukan JavaScript.
Izinkan skrip untuk melihat halaman ini.
Включите JavaScript в браузере.
Для просмотра страницы необходим JavaScript.
Сайт не работает без JavaScript.
Разрешите скрипты и файлы cookie.
请在浏览器中启用 JavaScript。
本网站需要 JavaScript 才能运行。
您的浏览器已禁用脚本，请启用后查看此页面。
请允许脚本和 Cookie。
ブラウザの JavaScript を有効にしてください。
このサイトを表示するには JavaScript が必要です。
JavaScript が無効です。
スクリプトを許可してください。
โปรดเปิดใช้งาน JavaScript ในเบราว์เซอร์
เว็บไซต์นี้ต้องใช้ JavaScript
กรุณาอนุญาตสคริปต์เพื่อดูหน้านี้
သင့်ဘရောက်ဇာတွင် JavaScript ကို ဖွင့်ပါ။
ဤစာမျက်နှာကို ကြည့်ရန် JavaScript လိုအပ်သည်။"""

#: Prose about such things, and the furniture of web pages.
MENTION = """The manual explains what the error code means and who should be told.
A chapter lists every error message with its cause and its remedy.
When the server reports an error, the job is tried again after a minute.
The team counted how often a page was not found and fixed the links.
If the message appears, note the number and tell the support desk.
When the dialog says that the session has expired, no work is lost.
The log contains a traceback that the developers read first.
The crawler skips pages that only ask the reader to enable JavaScript.
Earlier versions needed JavaScript, but the new one works without it.
The importer removes scripts, so no notice about them is left in the text.
The article shows how a page can be read without scripts.
Typesetters have used lorem ipsum since the sixteenth century.
Editors use dummy text to judge a layout before the copy exists.
A draft that still has placeholder text in it is sent back.
The checker rejects filler text, says the guide.
The template uses a variable for the name, which is filled in on printing.
Translators must leave placeholders and variables unchanged.
The syntax of a placeholder is explained in the appendix.
A missing placeholder is reported as a warning.
The word is written in brackets because the parser needs it.
Le manuel explique ce que signifie le code d’erreur.
Quand le message s’affiche, le travail n’est pas perdu.
Les versions précédentes exigeaient JavaScript, la nouvelle s’en passe.
Le faux texte est refusé lors de l’export.
Les balises et les variables ne se traduisent pas.
Das Handbuch erklärt, was der Fehlercode bedeutet.
Wenn die Meldung erscheint, ist die Arbeit gesichert.
Frühere Fassungen brauchten JavaScript, die neue nicht.
Entwürfe mit Blindtext werden zurückgewiesen.
Platzhalter bleiben beim Übersetzen unverändert.
El manual explica qué significa el código de error.
Cuando aparece el mensaje, el trabajo no se pierde.
Las versiones anteriores exigían JavaScript, la nueva no.
El texto de ejemplo se rechaza al exportar.
Las variables y las marcas no se traducen.
O manual explica o que significa o código de erro.
As versões anteriores exigiam JavaScript, a nova não.
O texto provisório é recusado na exportação.
As variáveis não são traduzidas.
Panduan menjelaskan arti kode kesalahan.
Versi lama memerlukan JavaScript, versi baru tidak.
Руководство объясняет, что означает код ошибки.
Прежние версии требовали JavaScript, новая обходится без него.
Переменные и метки при переводе не меняются.
手册说明了错误代码的含义。
旧版本需要 JavaScript，新版本不需要。
占位符在翻译时保持不变。
マニュアルにはエラーコードの意味が書かれている。
以前の版は JavaScript を必要としたが、新しい版は必要としない。
プレースホルダーは訳さずに残す。
คู่มืออธิบายความหมายของรหัสข้อผิดพลาด
รุ่นก่อนต้องใช้ JavaScript แต่รุ่นใหม่ไม่ต้อง
လက်စွဲတွင် အမှားကုဒ်၏ အဓိပ္ပာယ်ကို ရှင်းပြထားသည်။
ယခင်ဗားရှင်းများတွင် JavaScript လိုအပ်ခဲ့သည်။
Skip to main content
Skip to navigation
Home About us Contact
Menu Search Log in Register
Sign in Sign up Help
Search Menu Account
Terms of use Privacy policy Cookies
Imprint Privacy Terms
Print Share Save
Previous page Next page
Back to top"""

#: Names that template fields have, and instructions in their place.
FIELD_NAMES = """name
first name
last name
full name
your name
customer name
client name
company
company name
your company
your company name
your organization
address
street address
city
country
phone number
e-mail address
date
start date
end date
due date
today’s date
deadline
amount
total
price
invoice number
order number
order id
customer id
reference number
account
user
username
title
document title
project
project name
subject
department
signature
job title
reviewer
editor
author
contact
contact person
language
page count
number of pages
date of birth
name of client
insert name here
insert date
enter your name
enter amount
add title here
type text here
fill in
to be determined
tbd
todo
nom
prénom
nom du client
votre nom
votre entreprise
adresse
ville
montant
date de livraison
titre
insérer le nom
saisir la date
vorname
nachname
kundenname
name des kunden
ihr name
ihr unternehmen
ihre firma
anschrift
ort
betrag
datum
datum einfügen
titel
titel eintragen
bitte ausfüllen
nombre
apellido
nombre del cliente
su nombre
su empresa
dirección
ciudad
importe
fecha
fecha de entrega
título
introducir nombre
insertar fecha aquí
nome
sobrenome
nome do cliente
seu nome
sua empresa
endereço
cidade
valor
data
inserir nome aqui
nama
nama pelanggan
nama anda
perusahaan anda
alamat
kota
jumlah
tanggal
isi nama di sini
masukkan tanggal
имя
фамилия
имя клиента
ваше имя
ваша компания
адрес
город
сумма
дата
вставить имя
укажите дату
姓名
客户姓名
您的公司
公司名称
地址
城市
金额
日期
填写姓名
请输入日期
氏名
お客様名
会社名
御社名
住所
金額
日付
名前を入力
日付を記入
ชื่อ
ชื่อลูกค้า
บริษัทของคุณ
ที่อยู่
จำนวนเงิน
วันที่
ใส่ชื่อ
အမည်
ဖောက်သည်အမည်
သင့်ကုမ္ပဏီ
လိပ်စာ
ပမာဏ
ရက်စွဲ
အမည်ထည့်ရန်"""


#: What prose has in brackets.
ASIDES = """sic
p 0
pp 0
ch 0
fig 0
tab 0
see fig 0
see p 0
kap 0
s 0
abb 0
tab 0
vgl s 0
cap 0
pág 0
fig 0
chap 0
tabl 0
bab 0
hlm 0
гл 0
стр 0
с 0
рис 0
табл 0
см рис 0
см с 0
ср с 0
том 0
ibid
note
editor’s note
translator’s note
emphasis added
citation needed
see appendix
see below
see above
see the table
continued
optional
click here
left
right
photo
figure
image
video
music
laughter
applause
pause
unclear
illegible
redacted
deleted
edited
update
spoiler
link
source
footnote
blank page
page break
and so on
in euro
or not
if any
for example
that is
voir annexe
note du traducteur
siehe oben
siehe anhang
anmerkung der redaktion
véase el anexo
nota del traductor
ver anexo
lihat lampiran
см. выше
примечание переводчика
见附录
译者注
注を参照"""

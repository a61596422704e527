"""Texts on which the residue operator is measured. They were written after the rules
and no rule was changed for them; keep it that way, or the figures mean nothing."""

RESIDUE = [
    "Sorry, the page you are looking for could not be found.", "HTTP 429 Too Many Requests", "Your connection was reset. Please try again later.", "Error 1020: Access denied",
    "We're sorry, but something went wrong. If you are the application owner check the logs for more information.", "The requested URL /docs/intro was not found on this server.", "503 Service Temporarily Unavailable", "Internal error. Please contact support with reference 8831.",
    "This content is no longer available.", "You do not have permission to view this directory or page.", "Login required. Please sign in to continue.", "Server Error in '/' Application.",
    "Die angeforderte Seite wurde nicht gefunden.", "Cette page n'existe pas ou a été supprimée.", "La página que busca no existe.", "К сожалению, такой страницы не существует.",
    "ページが存在しません。", "您访问的页面不存在。", "Fatal error: Allowed memory size of 134217728 bytes exhausted in /var/www/index.php on line 12", "Traceback (most recent call last):\n  File \"app.py\", line 3, in <module>\nKeyError: 'user'",
    "Please enable cookies and reload the page.", "JavaScript is disabled in your browser. To use this site, turn it on.", "You must have JavaScript enabled to use this form.", "This site requires JavaScript to function properly.",
    "Checking if the site connection is secure", "Verify you are human by completing the action below.", "One more step: please complete the security check to access the site.", "Your browser is out of date. Update it to view this website correctly.",
    "We use scripts to show this content. Please allow scripts and refresh.", "Veuillez activer JavaScript dans votre navigateur.", "Por favor, habilite JavaScript para continuar.", "Для работы сайта включите JavaScript.",
    "このサイトを利用するには JavaScript を有効にしてください。", "Cookies must be enabled to log in.", "Please wait while your request is being verified...", "Access to this page has been denied because we believe you are using automation tools to browse the website.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "Insert text here", "Content goes here.", "Description to be added.", "Coming soon", "TODO: write this section", "TBA", "Placeholder text, replace before publishing.",
    "asdf asdf qwerty asdf zxcv asdf qwerty hjkl", "Add a short summary of your project here.", "This page is intentionally left blank.", "Under construction",
    "Dear {{customer_name}}, your order is on its way.", "Hello [First Name], welcome back to the list.", "Hi ${user}, your report is ready for you.", "Thank you, %(name)s, for your message to the team.", "The price is <%= price %> per month for all.", "Copyright [your company] for all years.",
    "Visit <INSERT-URL> to learn more about it.", "Contact us at {{ email }} for more details.", "Hello %FIRSTNAME%, we have news for you.", "Best regards, [Your Name]", "Welcome to @@SITE_NAME@@, the home of snippets.", "Please call {{phone}} between nine and five.",
]
EXPLAINING = [
    "When a link is broken the server sends status 404, and crawlers drop the address after some tries.", "The handler returns 503 while the index is rebuilt, so that clients try again later.", "To reproduce the bug, disable cookies and open the settings page twice.", "We moved the check for JavaScript support into the loader, which made the page faster.",
    "A placeholder such as `{{ name }}` is filled in by the template engine at build time.", "Use `${HOME}` in the config to point to the folder of the user.", "Lorem ipsum is a text that printers have used for centuries to show type without meaning.", "The error message \"access denied\" usually means that the token has expired.",
    "Our docs explain how to write a custom error page for your site.", "The function raises KeyError when the user is unknown; catch it and return a default.", "Cookies keep the session alive across requests; they are signed with a secret key.", "Fixed a crash when the cookie header was empty.",
    "Fixed: the script crashed because a cookie was disabled by the user.", "Cookies are required for baking day.", "The service is down for maintenance every Sunday at two, as the calendar shows.", "Sort the list first, then remove what is not found in the second one.",
    "How do I show a message when a file does not exist?", "The test checks that a page without scripts still shows the text.", "This release adds a captcha to the sign-up form and a switch to turn it off.", "Returns None if the key was not found, and raises no error.",
    "The gateway forwards requests to the nearest server and counts timeouts.", "Add a section that says what is coming soon in the roadmap.", "The README has a TODO list with seven open points and their owners.", "def get(x):\n    return cache.get(x) or 'not found'",
    "SELECT name FROM pages WHERE status = 404 ORDER BY name", "if (!navigator.cookieEnabled) { showNotice(); }", "Le serveur renvoie une erreur 404 quand la page est supprimée par son auteur.", "Wenn eine Seite nicht gefunden wird, zeigt der Server eine eigene Meldung mit einer Suche.",
    "Cuando falta una página, el registro guarda la dirección y la hora.", "Если страница не найдена, робот повторяет запрос через час.", "当页面不存在时，服务器返回状态码并记录日志。", "ページが見つからない場合、検索結果に戻ります。",
    "Rate limits protect the API: after a hundred calls a minute the client must wait.", "The browser sends cookies with each request unless told otherwise.", "We tested with scripts turned off and all links still worked.", "A forbidden word list is kept in the repository of the filter.",
    "Your first program prints a greeting; the second one reads a name.", "The domain of the function is the set of all lists that are sorted.", "Sorry for the late reply, I was away for two weeks.", "Oops, I meant the second argument, not the first.",
    "Something went wrong in my head when I named this variable.", "The page cache holds a thousand entries and drops the oldest.", "Access is granted by role; a denied request is written to the audit log.", "The upstream project released version two last week.",
    "Changelog\n- show a notice when JavaScript is off\n- fix typo\n- update all tests for the new parser", "Q: Why do I see a blank page?\nA: The bundle failed to load; look at the console for the reason.", "Please try the new parser and tell us what breaks.", "The session expired test waits one second and asks for the token again.",
    "Unsupported browsers are listed in the table below with their versions.", "The form needs a name, an address and a date.", "Just a moment of thought shows that the loop never ends.", "Verify that you are in the right folder before you run the script.",
    "Enable the cache with a flag and measure again.", "The parser treats `<insert>` as a tag and not as text.", "Use square brackets for lists: [name, date, company].", "An exception in the worker stops the job; the driver starts it again.",
    "We wrote a scanner for error pages; it found 31 of them in the crawl.", "The text field shows sample text until the user types.", "Bake the cookies for ten minutes and let them cool.", "The script is required reading for the actors.",
]

"""Hand-checked texts for calibration: (text, 1 if at least half of its characters stand in running sentences). Written for this purpose."""

HOLDOUT = [
    ("The host was taken off the network on Monday. Nobody could say who had opened the file, but the log shows that it was read twice before noon.", 1),
    ("we looked at the script again and it does nothing but write one key\nthe second file was never opened as far as we can tell from the share", 1),
    ("> I agree with the first note. The key was\n> written by the installer, and it is not\n> needed any more.\n\nThen please remove it and close the ticket.", 1),
    ("Rivera: Both 10.1.2.3 and http://example.test/a/b.ps1 answered, so the task C:\\tmp\\a.ps1 stayed on the host. It was removed later.", 1),
    ("Der Rechner wurde am Montag vom Netz genommen. Niemand wusste, wer die Datei geöffnet hatte, aber im Protokoll steht, dass sie zweimal gelesen wurde.", 1),
    ("Es gibt bisher keinen Hinweis darauf,\ndass der Schlüssel noch gebraucht wird,\nund wir haben ihn deshalb entfernt.", 1),
    ("El equipo fue retirado de la red el lunes. Nadie sabe quién abrió el archivo, pero el registro muestra que se leyó dos veces antes de las doce.", 1),
    ("Le poste a été retiré du réseau lundi. Personne ne sait qui a ouvert le fichier, mais le journal montre qu'il a été lu deux fois avant midi.", 1),
    ("Summary\n\nThe loader fetched one file and ran it. We have blocked the address and told the team.\n\n- 10.0.0.1\n- a.test", 1),
    ("Please check the mail gateway as well! It may have kept a copy of the file, and the sender used the same address last week.", 1),
    ("Puis 10.4.5.6 et http://b.example/x ont envoyé la commande au service, qui a écrit le fichier dans le dossier de nuit.", 1),
    ("- in the office\n- not for the server\n- on the same host as the loader\n- by the end of the week", 0),
    ("* nicht auf dem Server\n* nur für die Nacht\n* noch ein Eintrag zu dem Ticket", 0),
    ("1. open the mail\n2. copy the key\n3. close it", 0),
    ("2025-01-02 10:11:12 [INFO] a.b in the office only\n2025-01-02 10:11:13 [WARN] a.c not for the server\n2025-01-02 10:11:15 [INFO] a.b back to the ticket", 0),
    ("name,count,seen,state\nalpha,12,2025-01-01,open\nbeta,7,2025-01-04,shut\ngamma,9,2025-02-01,open", 0),
    ("| host | owner | note |\n|---|---|---|\n| a1 | night team | not in use |\n| b2 | lab | for the test only |", 0),
    ("type      state     remark\nip        open      not in the office\ndomain    shut      for the night only\nurl       open      on the same host", 0),
    ("$a = 'x1' + 'y2'\nif (Test-Path $a) { $b += 17 }\nfunction Get-It { param($q) return $q * 3 }", 0),
    ("for /l %%i in (1,1,20) do echo run %%i\nif exist a.txt goto end\nset name=value", 0),
    ("host: 10.2.3.4.\npath: C:\\tmp\\x.exe.\nowner: night team.\nhash: 900150983cd24fb0d6963f7d28e17f72.", 0),
    ("alpha alpha alpha alpha alpha alpha alpha alpha alpha alpha alpha alpha", 0),
    ("a9 0f 33 c2 78 b1 44 90\n12 ff 08 7c 55 e2 6a 3b", 0),
    ("..... ---- ///// 12345 ;;;; ####", 0),
    ("The list follows.\n\n- 10.0.0.1\n- 10.0.0.2\n- http://a.test/long/path/to/file.bin\n- http://b.test/long/path/to/file.bin\n- http://c.test/x", 0),
    ("var a = String.fromCharCode(97,98,99);\nrun(unescape('%41'), 2);\nb['x'] = 17;", 0),
    ("key the so over was from or they file on a mapper not it by for stone\nis and lamp that of to river so but with queue an were from paper.", 0),
    ("stein nicht und der oder mit auf lampe das von papier ein in den sich zu fluss es auch so noch. der mit stein auf und von papier das.", 0),
    ("que no la piedra y en los papel se por con es lo un de río más para al lámpara su. de que papel los en no y con la es.", 0),
    ("et le ne pierre que dans des papier est pas plus lampe il une en sur rivière ce nous pour la de. que dans pierre les et une pas.", 0),
]

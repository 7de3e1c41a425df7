"""Texts that readers see and that results must equal: fixed values, in one place."""

UNIT_OF = {"pdf": "page", "docx": "section", "pptx": "slide"}
UNIT_NAMES = {"page": ("pagina", "pagina's"), "section": ("sectie", "secties"), "slide": ("dia", "dia's")}

# Warnings of pages; {n} stands for a number.
SCANNED = "geen tekstlaag - waarschijnlijk een scan, niets opgehaald"
SPARSE = "heel weinig tekst ({n} tekens) op een pagina met beeld"
TABLES_FOUND = "{n} tabel(len) gevonden - controleer de kolommen"
TABLES_DROPPED = "{n} valse tabel(len) uit vectorvormen verwijderd - kijk naar het figuur zelf"
TEXT_RECOVERED = "tekst werd opgeslokt door vectorvormen; pagina opnieuw gedaan zonder die vormen - een tabel hier staat als platte tekst"
FIGURE_LABELS = "_Labels in figuur:_ "

# Word and slides.
CHART_NOT_CONVERTED = "grafiek (Word-chart) niet omgezet"
CHART_PLACE = "_[Grafiek niet omgezet]_"
VECTOR_FIGURE = "figuur in {n}-formaat, niet zichtbaar in de meeste viewers"
SMARTART = "SmartArt: alleen de tekst is overgenomen"
EMBEDDED = "ingesloten object niet omgezet"
SERIES = "Reeks "
CHART = "_Grafiek"
EMPTY_CHART = "_[Grafiek zonder gegevens]_"
NOTES = "**Notities:**"
SLIDE = "## Dia "
HIDDEN_SLIDE = " _(verborgen dia)_"

# Files and reports.
OLD_OFFICE = "oud of versleuteld Office-bestand: sla het op als .docx of .pptx zonder wachtwoord"
UNKNOWN_FORMAT = "onbekend bestandsformaat"
NO_EXTRACTOR = "geen PDF-extractor ingesteld"
DONE, FAILED = "klaar", "mislukt: "
REPORT = ("bestand", "pad", "formaat", "eenheden", "omgezet", "met waarschuwing", "gemaskeerd", "map", "status")
REVIEW_REPORT = ("bestand", "pad", "formaat", "eenheden", "omgezet", "nagekeken", "aangepast", "met waarschuwing", "gemaskeerd", "map in zip", "status")

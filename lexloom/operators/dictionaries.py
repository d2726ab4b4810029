"""Static dictionaries."""

# English months, units, currencies and their Portuguese forms.
MONTHS = {"january": "janeiro", "february": "fevereiro", "march": "março", "april": "abril", "may": "maio", "june": "junho", "july": "julho", "august": "agosto", "september": "setembro", "october": "outubro", "november": "novembro", "december": "dezembro"}
UNITS = {"miles": "milhas", "mile": "milha", "feet": "pés", "foot": "pé", "inches": "polegadas", "inch": "polegada", "yards": "jardas", "yard": "jarda", "pounds": "libras", "pound": "libra", "ounces": "onças", "ounce": "onça"}
CURRENCIES = {"$": "dólares", "£": "libras", "€": "euros", "¥": "ienes"}
# Words of negation.
NEGATIONS_EN = ("not", "never", "neither", "nor", "nobody", "nothing", "nowhere", "cannot", "can't", "didn't", "doesn't", "wasn't", "weren't", "won't", "wouldn't", "shouldn't", "haven't", "hasn't", "isn't", "aren't", "don't")
NEGATIONS_PT = ("não", "nunca", "jamais", "nenhum", "nenhuma", "ninguém", "nada", "nem", "tampouco")

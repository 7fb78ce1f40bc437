"""Ordered rewrite rules between the legacy Zawgyi font order and standard Unicode.

The two tables are fixed values: an ordered cascade in which every rule is a
(pattern, replacement) pair applied globally before the next one runs.  They
descend from the public-domain (WTFPL) Rabbit converter project.
"""

# Conversion patterns, in their order of application.
LEGACY_TO_STANDARD = [
    (r"([ိီွု့႕])\1+", r"\1"),
    ("\u200b", ""),
    ("ွြ", "ႊ"),
    ("(ွ|ႇ)", "ှ"),
    ("ြ", "ွ"),
    ("(ျ|ၾ|ၿ|ႀ|ႁ|ႂ|ႃ|ႄ)", "ြ"),
    ("(်|ၽ)", "ျ"),
    ("္", "်"),
    ("(ၦ|ၧ)", "္ဆ"),
    ("ၪ", "ဉ"),
    ("ၫ", "ည"),
    ("ၬ", "္ဋ"),
    ("ၭ", "္ဌ"),
    ("ၮ", "ဍ္ဍ"),
    ("ၯ", "ဍ္ဎ"),
    ("ၰ", "္ဏ"),
    ("(ၱ|ၲ)", "္တ"),
    ("ၠ", "္က"),
    ("ၡ", "္ခ"),
    ("ၢ", "္ဂ"),
    ("ၣ", "္ဃ"),
    ("ၥ", "္စ"),
    ("ၨ", "္ဇ"),
    ("ၩ", "္ဈ"),
    ("(ၳ|ၴ)", "္ထ"),
    ("ၵ", "္ဒ"),
    ("ၶ", "္ဓ"),
    ("ၷ", "္န"),
    ("ၸ", "္ပ"),
    ("ၹ", "္ဖ"),
    ("ၺ", "္ဗ"),
    ("ၼ", "္မ"),
    ("ႅ", "္လ"),
    ("ဳ", "ု"),
    ("ဴ", "ူ"),
    ("ဿ", "ူ"),
    ("ႆ", "ဿ"),
    ("ံႈ", "ႈံ"),
    ("ႈ", "ှု"),
    ("ႉ", "ှူ"),
    ("ႊ", "ွှ"),
    ("ျၤ", "ၤျ"),
    ("ြ([က-အ])([ၤႋႍ])", r"\1ြ\2"),
    ("(ေ)?([က-အ၀-၉])(ြ)?ၤ", r"င်္\1\2\3"),
    ("(ေ)?([က-အ])(ျ|ြ)?ႋ", r"င်္\1\2\3ိ"),
    ("(ေ)?([က-အ])(ျ)?ႌ", r"င်္\1\2\3ီ"),
    ("(ေ)?([က-အ])([ျြ])?ႍ", r"င်္\1\2\3ံ"),
    ("ႎ", "ိံ"),
    ("ႏ", "န"),
    ("႐", "ရ"),
    ("႑", "ဏ္ဍ"),
    ("႒", "ဋ္ဌ"),
    ("မာ(ၻ|႓)", "မ္ဘာ"),
    ("(ၻ|႓)", "္ဘ"),
    ("(႔|႕)", "့"),
    ("([က-အ])့ဲ", r"\1ဲ့"),
    ("႖", "္တွ"),
    ("႗", "ဋ္ဋ"),
    ("ြ([က-အ])([က-အ])?", r"\1ြ\2"),
    ("([က-အ])ြ်", r"ြ\1်"),
    ("၇(?=[ာ-ူဲံ-းွး])", "ရ"),
    ("ေ၇", "ေရ"),
    ("၀(ီ|ု|ို|ူ|ံ|ွ|ှ)", r"ဝ\1"),
    ("([^၀၁၂၃၄၅၆၇၈၉])၀ါ", r"\1ဝါ"),
    ("([၀၁၂၃၄၅၆၇၈၉])၀ါ(?!း)", r"\1ဝါ"),
    ("^၀(?=ါ)", "ဝ"),
    ("၀ိ(?! ?/)", "ဝိ"),
    ("([^၀-၉])၀([^၀-၉ ]|[၊။])", r"\1ဝ\2"),
    (r"([^၀-၉])၀(?=[\f\n\r])", r"\1ဝ"),
    ("([^၀-၉])၀$", r"\1ဝ"),
    ("ေ([က-အဿ])(ှ)?(ျ)?", r"\1\2\3ေ"),
    ("([က-အ])ေ([ျြွှ]+)", r"\1\2ေ"),
    ("ဲွ", "ွဲ"),
    ("([ိီ])ျ", r"ျ\1"),
    ("ွျ", "ျွ"),
    ("့်", "့်"),
    ("ု(ိ|ီ|ံ|့)ု", r"ု\1"),
    ("(ု|ူ)(ိ|ီ)", r"\2\1"),
    ("(ှ)(ျ|ြ)", r"\2\1"),
    ("ဥ(?=[့]?[်ာ])", "ဉ"),
    ("ဦ", "ဦ"),
    ("စျ", "ဈ"),
    ("ံ(ု|ူ)", r"\1ံ"),
    ("ေ့ှ", "ှေ့"),
    ("ေှာ", "ှော"),
    ("ၚ", "ါ်"),
    ("ေျှ", "ျှေ"),
    ("(ိ|ီ)(ွ|ှ)", r"\2\1"),
    ("ာ္([က-အ])", r"္\1ာ"),
    ("္ြ်္([က-အ])", r"်္\1ြ"),
    ("ြ္([က-အ])", r"္\1ြ"),
    ("ံ္([က-အ])", r"္\1ံ"),
    ("၎", "၎င်း"),
    ("၀(ါ|ာ|ံ)", r"ဝ\1"),
    ("ဥ္", "ဉ္"),
    ("([က-အ])ြေွ", r"\1ြွေ"),
    ("([က-အ])ျေွ(ှ)?", r"\1ျွ\2ေ"),
    ("([က-အ])ွေျ", r"\1ျွေ"),
    ("([က-အ])ေ(္[က-အ]ွ?)", r"\1\2ေ"),
    ("း်", "်း"),
    ("ိ်|်ိ", "ိ"),
    ("ို်", "ို"),
    (" ့", "့"),
    ("့ံ", "ံ့"),
    ("[ိ]+", "ိ"),
    ("[်]+", "်"),
    ("[ွ]+", "ွ"),
    ("[့]+", "့"),
    ("[ီ]+", "ီ"),
    ("ိီ|ီိ", "ီ"),
    ("ုိ", "ို"),
    ("့့", "့"),
    ("ဲဲ", "ဲ"),
    ("၄င်း", "၎င်း"),
    ("([ိီ])္([က-အ])", r"္\2\1"),
    ("(ြေ)္([က-အ])", r"္\2\1"),
    ("ံွ", "ွံ"),
    ("၇((?=[က-အ]်)|(?=[ာ-ူဲံ-းွှ]))", "ရ"),
]

STANDARD_TO_LEGACY = [
    ("င်္", "ၤ"),
    ("္တွ", "႖"),
    ("ါ်", "ၚ"),
    ("ိံ", "ႎ"),
    ("၎င်း", "၎"),
    ("[ဥဉ](?=္)", "ၪ"),
    ("ဉ(?=[ုူ])", "ဥ"),
    ("[ဥဉ](?=[့]?[်])", "ဥ"),
    ("ည(?=[္ွ])", "ၫ"),
    ("(္[က-အ])(ိ){0,1}ု", r"\1\2ဳ"),
    ("(္[က-အ])ူ", r"\1ဴ"),
    ("န(?=[ိီု်]?[ူွှု္])", "ႏ"),
    ("န(?=်ု )", "ႏ"),
    ("နြ", "ႏြ"),
    ("္က", "ၠ"),
    ("္ခ", "ၡ"),
    ("္ဂ", "ၢ"),
    ("္ဃ", "ၣ"),
    ("္စ", "ၥ"),
    ("္ဆ", "ၦ"),
    ("္ဇ", "ၨ"),
    ("္ဈ", "ၩ"),
    ("္ဋ", "ၬ"),
    ("ဋ္ဌ", "႒"),
    ("္ဌ", "ၭ"),
    ("ဍ္ဍ", "ၮ"),
    ("ဍ္ဎ", "ၯ"),
    ("္ဏ", "ၰ"),
    ("္တ", "ၱ"),
    ("္ထ", "ၳ"),
    ("္ဒ", "ၵ"),
    ("္ဓ", "ၶ"),
    ("္[နႏ]", "ၷ"),
    ("္ပ", "ၸ"),
    ("္ဖ", "ၹ"),
    ("္ဗ", "ၺ"),
    ("္ဘ", "ၻ"),
    ("္မ", "ၼ"),
    ("္လ", "ႅ"),
    ("ဿ", "ႆ"),
    ("ွှ", "ႊ"),
    ("(ၤ)([က-အ])([ျြ]?)ိ", r"\2\3ႋ"),
    ("(ၤ)([က-အ])([ျြ]?)ီ", r"\2\3ႌ"),
    ("(ၤ)([က-အ])([ျြ]?)ံ", r"\2\3ႍ"),
    ("(ၤ)([က-အ၀-၉])([ျြ]?)([ေ]?)", r"\2\3\4\1"),
    ("ရ(?=([ိီ]?)[ုူွႊ])", "႐"),
    ("ဏ္ဍ", "႑"),
    ("ဋ္ဋ", "႗"),
    ("([က-အႏဩၪၮၯႆ႐႑႒႗႖])([ၠ-ၩၬၭၰ-ၼႅႊ])?([ျ-ှ]*)?ေ", r"ေ\1\2\3"),
    ("ြှ", "ြႇ"),
    ("([က-အႏဩ])([ၠ-ၩၬၭၰ-ၼႅ])?(ြ)", r"\3\1\2"),
    ("်", "္"),
    ("ျ", "်"),
    ("ြ", "ျ"),
    ("ွ", "ြ"),
    ("ှ", "ွ"),
    ("([^်ည])ွ([ိီ]?)ု", r"\1ႈ\2"),
    ("([ရ်ြႊႈ႐])([ူွ])?([ဲံ္ိီႋႌႍႎ]?)(ု)?့", r"\1\2\3\4႕"),
    ("([ုနူွ])([ဲံ္ိီႋႌႍႎ]?)့", r"\1\2႔"),
    ("([ျ])([က-အ])([ႇ]?)([ံိီႋႌႍႎ]?)ု", r"\1\2\3\4ဳ"),
    ("([ျ])([က-အ])([ႇ]?)([ံိီႋႌႍႎ]?)ူ", r"\1\2\3\4ဴ"),
    ("([်ြညဈဋဌဍဠဥ])([ွ]?)([ံိီႋႌႍႎ]?)ု", r"\1\2\3ဳ"),
    ("([်ြညဈဋဌဍဠဥ])(ွ?)([ံိီႋႌႍႎ]?)ူ", r"\1\2\3ဴ"),
    ("([ညဠဉ])ွ", r"\1ႇ"),
    ("ွူ", "ႉ"),
    ("ျ([ကဃဆဏတထဘယလယသဟ])", r"ၾ\1"),
    ("ၾ([ကဃဆဏတထဘယလယသဟ])([ြႊ])([ဲံိီႋႌႍႎ])", r"ႄ\1\2\3"),
    ("ၾ([ကဃဆဏတထဘယလယသဟ])([ြႊ])", r"ႂ\1\2"),
    ("ၾ([ကဃဆဏတထဘယလယသဟ])([ဳဴ]?)([ဲံိီႋႌႍႎ])", r"ႀ\1\2\3"),
    ("ျ([က-အ])([ြႊ])([ဲံိီႋႌႍႎ])", r"ႃ\1\2\3"),
    ("ျ([က-အ])([ြႊ])", r"ႁ\1\2"),
    ("ျ([က-အ])([ဳဴ]?)([ဲံိီႋႌႍႎ])", r"ၿ\1\2\3"),
    ("်ွ", "ွ်"),
    ("်([ြႊ])", r"\1ၽ"),
    ("([ဳဴ])(ံ?)႔", r"\1\2႕"),
    ("ႏၱ", "ႏၲ"),
    ("ႏၳ", "ႏၴ"),
    ("([က-အ])([ၻၦ])ာ", r"\1ာ\2"),
    ("ာ([ၻၦ])့", r"ာ\1႔"),
    ("၇((?=[က-အ]္)|(?=[ာ-ူဲံ-းြွ]))", "ရ"),
]

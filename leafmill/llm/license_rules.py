"""Licence signatures, written by hand for operator 4.

Patterns see UTF-8 text with A-Z lower-cased and are bytes regular expressions in verbose-free form, with abbreviations:
``_`` stands for any run of blanks, line ends and comment marks, ``<lic>`` for licence or license. A run is taken whole: no
hyphen or other mark of it can be asked for next to it. ``<dash>`` is a run with a hyphen inside, ``<long>`` one of three or more,
``<lead>`` one from its beginning, ``<giving>`` one that may leave marks to a class after it. Addresses have no abbreviations: their ``_`` is itself.
A keyword is derived for each alternative of a pattern; a text with none of them is never searched for that pattern.
A block's label and priority head it: a larger number wins where detections overlap.
"""

from __future__ import annotations

#: Licences whose SPDX identifier, name and address are regular enough to be made from one line each:
#: identifier | name | address, each a pattern or "-".
FAMILIES = r"""
0bsd | zero[- ]clause_bsd_<lic>|bsd_zero[- ]clause_<lic> | opensource\.org/licenses?/0bsd
afl-1.1 | academic_free_<lic>,?_v(?:ersion|\.)?_?1\.1 | -
afl-2.0 | academic_free_<lic>,?_v(?:ersion|\.)?_?2\.0 | opensource\.org/licenses?/afl-2\.0
afl-2.1 | academic_free_<lic>,?_v(?:ersion|\.)?_?2\.1 | opensource\.org/licenses?/afl-2\.1
afl-3.0 | academic_free_<lic>,?_v(?:ersion|\.)?_?3\.0 | opensource\.org/licenses?/afl-3\.0
agpl-3.0 | (?:gnu_)?affero_general_public_<lic>(?:,?_v(?:ersion|\.)?_?3)? | gnu\.org/licenses/agpl(?:-3\.0)?
apache-1.0 | apache_(?:software_)?<lic>,?_v(?:ersion|\.)?_?1\.0 | apache\.org/licenses/license-1\.0
apache-1.1 | apache_(?:software_)?<lic>,?_v(?:ersion|\.)?_?1\.1 | apache\.org/licenses/license-1\.1
apache-2.0 | apache_(?:software_)?<lic>,?_\(?v(?:ersion|\.)?_?2(?:\.0)? | (?:www\.)?apache\.org/licenses/license-2\.0
apsl-1.0 | apple_public_source_<lic>,?_v(?:ersion|\.)?_?1\.0 | opensource\.apple\.com/apsl/1\.0
apsl-2.0 | apple_public_source_<lic>(?:,?_v(?:ersion|\.)?_?2\.0)? | opensource\.apple\.com/apsl
artistic-1.0 | (?:perl_)?artistic_<lic>,?_(?:v(?:ersion|\.)?_?)?1\.0 | opensource\.org/licenses?/artistic-license-1\.0
artistic-2.0 | artistic_<lic>,?_(?:v(?:ersion|\.)?_?)?2\.0 | opensource\.org/licenses?/artistic-license-2\.0
beerware | beer[- ]?ware_<lic> | -
bitstream-vera | bitstream_vera_(?:fonts?_)?(?:copyright|<lic>) | -
blueoak-1.0.0 | blue_oak_model_<lic>(?:_1\.0\.0)? | blueoakcouncil\.org/license/1\.0\.0
bsd-1-clause | (?:1|one)[- ]clause_bsd_<lic> | opensource\.org/licenses?/bsd-1-clause
bsd-2-clause | (?:2|two)[- ]clause_bsd_<lic>|simplified_bsd_<lic>|freebsd_<lic> | opensource\.org/licenses?/bsd-2-clause
bsd-3-clause | (?:3|three)[- ]clause_bsd_<lic>|(?:new|modified|revised)_bsd_<lic> | opensource\.org/licenses?/bsd-3-clause
bsd-4-clause | (?:4|four)[- ]clause_bsd_<lic>|original_bsd_<lic> | -
bsl-1.0 | boost_software_<lic>(?:(?:_?,)?_v(?:ersion|\.)?_?1\.0)? | boost\.org/license_1_0\.txt
busl-1.1 | business_source_<lic>(?:,?_(?:v(?:ersion|\.)?_?)?1\.1)? | mariadb\.com/bsl11
cal-1.0 | cryptographic_autonomy_<lic> | opensource\.org/licenses?/cal-1\.0
catosl-1.1 | computer_associates_trusted_open_source_<lic> | -
cc-by-1.0 | creative_commons_attribution_1\.0 | creativecommons\.org/licenses/by/1\.0
cc-by-2.0 | creative_commons_attribution_2\.0 | creativecommons\.org/licenses/by/2\.0
cc-by-2.5 | creative_commons_attribution_2\.5 | creativecommons\.org/licenses/by/2\.5
cc-by-3.0 | creative_commons_attribution_3\.0|cc[- ]by[- ]3\.0 | creativecommons\.org/licenses/by/3\.0
cc-by-4.0 | creative_commons_attribution_4\.0|cc[- ]by[- ]4\.0 | creativecommons\.org/licenses/by/4\.0
cc-by-nc-3.0 | creative_commons_attribution-non-?commercial_3\.0|cc[- ]by-nc[- ]3\.0 | creativecommons\.org/licenses/by-nc/3\.0
cc-by-nc-4.0 | creative_commons_attribution-non-?commercial_4\.0|cc[- ]by-nc[- ]4\.0 | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-nd-3.0 | creative_commons_attribution-non-?commercial-no_?deriv(?:ative)?s_3\.0|cc[- ]by-nc-nd[- ]3\.0 | creativecommons\.org/licenses/by-nc-nd/3\.0
cc-by-nc-nd-4.0 | creative_commons_attribution-non-?commercial-no_?deriv(?:ative)?s_4\.0|cc[- ]by-nc-nd[- ]4\.0 | creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nc-sa-3.0 | creative_commons_attribution-non-?commercial-share_?alike_3\.0|cc[- ]by-nc-sa[- ]3\.0 | creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-sa-4.0 | creative_commons_attribution-non-?commercial-share_?alike_4\.0|cc[- ]by-nc-sa[- ]4\.0 | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nd-3.0 | creative_commons_attribution-no_?deriv(?:ative)?s_3\.0|cc[- ]by-nd[- ]3\.0 | creativecommons\.org/licenses/by-nd/3\.0
cc-by-nd-4.0 | creative_commons_attribution-no_?deriv(?:ative)?s_4\.0|cc[- ]by-nd[- ]4\.0 | creativecommons\.org/licenses/by-nd/4\.0
cc-by-sa-2.0 | creative_commons_attribution-share_?alike_2\.0|cc[- ]by-sa[- ]2\.0 | creativecommons\.org/licenses/by-sa/2\.0
cc-by-sa-3.0 | creative_commons_attribution-share_?alike_3\.0|cc[- ]by-sa[- ]3\.0 | creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-4.0 | creative_commons_attribution-share_?alike_4\.0|cc[- ]by-sa[- ]4\.0 | creativecommons\.org/licenses/by-sa/4\.0
cc0-1.0 | cc0_1\.0(?:_universal)?|creative_commons_zero | creativecommons\.org/publicdomain/zero/1\.0
cddl-1.0 | common_development_and_distribution_<lic>(?:,?_v(?:ersion|\.)?_?1\.0)? | opensource\.org/licenses?/cddl-1\.0
cddl-1.1 | common_development_and_distribution_<lic>,?_v(?:ersion|\.)?_?1\.1 | -
cecill-1.0 | cecill_free_software_<lic>(?:_agreement)?_v?1\.0 | cecill\.info/licences/licence_cecill_v1
cecill-2.1 | cecill_free_software_<lic>(?:_agreement)?(?:_v?2\.1)? | cecill\.info/licences/licence_cecill_v2\.1
cecill-b | cecill-b_(?:free_software_)?<lic> | cecill\.info/licences/licence_cecill-b
cecill-c | cecill-c_(?:free_software_)?<lic> | cecill\.info/licences/licence_cecill-c
cern-ohl-p-2.0 | cern_open_hardware_licence_version_2<dash>permissive | -
cern-ohl-s-2.0 | cern_open_hardware_licence_version_2<dash>strongly_reciprocal | -
cern-ohl-w-2.0 | cern_open_hardware_licence_version_2<dash>weakly_reciprocal | -
clartistic | clarified_artistic_<lic> | -
cpal-1.0 | common_public_attribution_<lic> | opensource\.org/licenses?/cpal-1\.0
cpl-1.0 | common_public_<lic>(?:,?_v(?:ersion|\.)?_?1\.0)? | opensource\.org/licenses?/cpl1\.0
cpol-1.02 | code_project_open_<lic> | codeproject\.com/info/cpol10
ecl-2.0 | educational_community_<lic>(?:,?_v(?:ersion|\.)?_?2\.0)? | opensource\.org/licenses?/ecl-2\.0
efl-2.0 | eiffel_forum_<lic>(?:,?_v(?:ersion|\.)?_?2)? | opensource\.org/licenses?/efl-2\.0
elastic-2.0 | elastic_<lic>_2\.0 | elastic\.co/licensing/elastic-license
epl-1.0 | eclipse_public_<lic>,?_v(?:ersion|\.)?_?1\.0 | eclipse\.org/legal/epl-v10
epl-2.0 | eclipse_public_<lic>,?_v(?:ersion|\.)?_?2\.0 | eclipse\.org/legal/epl-(?:v20|2\.0)
erlpl-1.1 | erlang_public_<lic> | erlang\.org/eplicense
eudatagrid | eu_datagrid_software_<lic> | -
eupl-1.1 | european_union_public_licence,?_v(?:ersion|\.)?_?1\.1 | -
eupl-1.2 | european_union_public_licence(?:,?_v(?:ersion|\.)?_?1\.2)? | joinup\.ec\.europa\.eu/software/page/eupl
fair | fair_<lic>_\(fair\) | opensource\.org/licenses?/fair
frameworx-1.0 | frameworx_open_<lic> | -
ftl | freetype_(?:project_)?<lic> | freetype\.org/ftl
gfdl-1.1 | gnu_free_documentation_<lic>,?_v(?:ersion|\.)?_?1\.1 | gnu\.org/licenses/old-licenses/fdl-1\.1
gfdl-1.2 | gnu_free_documentation_<lic>,?_v(?:ersion|\.)?_?1\.2 | gnu\.org/licenses/old-licenses/fdl-1\.2
gfdl-1.3 | gnu_free_documentation_<lic>(?:,?_v(?:ersion|\.)?_?1\.3)? | gnu\.org/licenses/fdl
gpl-1.0 | (?:gnu_)?general_public_<lic>,?_\(?v(?:ersion|\.)?_?1(?:\.0)?(?!\.?[0-9]) | gnu\.org/licenses/old-licenses/gpl-1\.0
gpl-2.0 | (?:gnu_)?general_public_<lic>,?_\(?v(?:ersion|\.)?_?2(?:\.0)?(?!\.?[0-9]) | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 | (?:gnu_)?general_public_<lic>,?_\(?v(?:ersion|\.)?_?3(?:\.0)?(?!\.?[0-9]) | gnu\.org/licenses/gpl-3\.0
hpnd | historical_permission_notice_and_disclaimer | opensource\.org/licenses?/hpnd
ibm-pibs | ibm_powerpc_initialization_and_boot_software | -
icu | icu_<lic>(?:<dash>icu)? | -
ijg | independent_jpeg_group(?:'s)?_<lic> | -
imlib2 | imlib2_<lic> | -
intel | intel_open_source_<lic> | opensource\.org/licenses?/intel
ipa | ipa_font_<lic> | opensource\.org/licenses?/ipafont
ipl-1.0 | ibm_public_<lic>(?:,?_v(?:ersion|\.)?_?1\.0)? | opensource\.org/licenses?/ibmpl
isc | isc_<lic> | opensource\.org/licenses?/isc
json | json_<lic> | json\.org/license
knuth-ctan | knuth_ctan_<lic> | -
lal-1.3 | licence_art_libre_1\.3|free_art_<lic>_1\.3 | artlibre\.org/licence/lal
lgpl-2.0 | (?:gnu_)?(?:library|lesser)_general_public_<lic>,?_\(?v(?:ersion|\.)?_?2(?:\.0)?(?!\.?[0-9]) | gnu\.org/licenses/old-licenses/lgpl-2\.0
lgpl-2.1 | (?:gnu_)?(?:library|lesser)_general_public_<lic>,?_\(?v(?:ersion|\.)?_?2\.1 | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 | (?:gnu_)?lesser_general_public_<lic>,?_\(?v(?:ersion|\.)?_?3(?:\.0)?(?!\.?[0-9]) | gnu\.org/licenses/lgpl-3\.0
libpng | libpng_<lic> | libpng\.org/pub/png/src/libpng-license
libtiff | libtiff_<lic> | -
liliq-p-1.1 | licence_libre_du_qu.{1,2}bec<dash>permissive | -
lpl-1.02 | lucent_public_<lic> | opensource\.org/licenses?/lpl-1\.02
lppl-1.3c | latex_project_public_<lic>(?:,?_v(?:ersion|\.)?_?1\.3c?)? | latex-project\.org/lppl
miros | miros_licen[cs]e | opensource\.org/licenses?/miros
mit | (?:the_)?mit_<lic>|expat_<lic> | opensource\.org/licenses?/mit
mit-0 | mit[- ]no[- ]attribution|mit-0_<lic> | opensource\.org/licenses?/mit-0
motosoto | motosoto_open_source_<lic> | -
mpl-1.0 | mozilla_public_<lic>,?_v(?:ersion|\.)?_?1\.0 | mozilla\.org/mpl/1\.0
mpl-1.1 | mozilla_public_<lic>,?_v(?:ersion|\.)?_?1\.1 | mozilla\.org/mpl/(?:mpl-)?1\.1
mpl-2.0 | mozilla_public_<lic>,?_v(?:ersion|\.)?_?2\.0 | mozilla\.org/(?:en-us/)?mpl/2\.0
ms-pl | microsoft_public_<lic> | opensource\.org/licenses?/ms-pl
ms-rl | microsoft_reciprocal_<lic> | opensource\.org/licenses?/ms-rl
mulanpsl-2.0 | mulan_permissive_software_<lic>(?:,?_v(?:ersion|\.)?_?2)? | license\.coscl\.org\.cn/mulanpsl2
multics | multics_<lic> | -
nasa-1.3 | nasa_open_source_agreement | opensource\.org/licenses?/nasa-1\.3
naumen | naumen_public_<lic> | -
ncsa | university_of_illinois(?:/ncsa)?_open_source_<lic> | opensource\.org/licenses?/ncsa
ngpl | nethack_general_public_<lic> | -
nokia | nokia_open_source_<lic> | -
nposl-3.0 | non-profit_open_software_<lic> | -
npl-1.1 | netscape_public_<lic> | mozilla\.org/mpl/npl
ntp | ntp_<lic> | opensource\.org/licenses?/ntp
oclc-2.0 | oclc_research_public_<lic> | -
odbl-1.0 | open_(?:data_commons_open_)?database_<lic> | opendatacommons\.org/licenses/odbl
odc-by-1.0 | open_data_commons_attribution_<lic> | opendatacommons\.org/licenses/by
ofl-1.1 | sil_open_font_<lic> | scripts\.sil\.org/ofl
ogtsl | open_group_test_suite_<lic> | -
oldap-2.8 | openldap_public_<lic> | openldap\.org/software/release/license
openssl | openssl_<lic> | openssl\.org/source/license
osl-1.0 | open_software_<lic>,?_v(?:ersion|\.)?_?1\.0 | -
osl-2.1 | open_software_<lic>,?_v(?:ersion|\.)?_?2\.1 | -
osl-3.0 | open_software_<lic>,?_v(?:ersion|\.)?_?3\.0 | opensource\.org/licenses?/osl-3\.0
parity-7.0.0 | parity_public_<lic> | paritylicense\.com
pddl-1.0 | public_domain_dedication_(?:and|&)_<lic> | opendatacommons\.org/licenses/pddl
php-3.0 | php_<lic>,?_v(?:ersion|\.)?_?3\.0(?!\.?[0-9]) | php\.net/license/3_0(?!1)
php-3.01 | php_<lic>,?_v(?:ersion|\.)?_?3\.01 | php\.net/license/3_01
polyform-noncommercial-1.0.0 | polyform_noncommercial_<lic> | polyformproject\.org/licenses/noncommercial
postgresql | postgresql_<lic> | opensource\.org/licenses?/postgresql
psf-2.0 | python_software_foundation_<lic> | python\.org/psf/license
python-2.0 | python_<lic>_2\.0|cnri_python_<lic> | opensource\.org/licenses?/python-2\.0
qpl-1.0 | q_public_<lic> | opensource\.org/licenses?/qtpl
rpl-1.5 | reciprocal_public_<lic> | opensource\.org/licenses?/rpl-1\.5
rpsl-1.0 | realnetworks_public_source_<lic> | -
rscpl | ricoh_source_code_public_<lic> | -
ruby | ruby(?:'s)?_<lic> | ruby-lang\.org/en/(?:about/)?license
sgi-b-2.0 | sgi_free_software_<lic>_b | oss\.sgi\.com/projects/freeb
simpl-2.0 | simple_public_<lic> | opensource\.org/licenses?/simpl-2\.0
sissl | sun_industry_standards_source_<lic> | -
sleepycat | sleepycat_<lic> | opensource\.org/licenses?/sleepycat
spl-1.0 | sun_public_<lic> | -
sspl-1.0 | server_side_public_<lic> | mongodb\.com/licensing/server-side-public-license
tcl | tcl/tk_<lic> | tcl\.tk/software/tcltk/license
ucl-1.0 | upstream_compatibility_<lic> | -
unicode-dfs-2016 | unicode(?:,_inc\.)?_<lic>_agreement | unicode\.org/copyright
unlicense | (?<![a-z])(?:the_)?unlicense(?![a-z]) | unlicense\.org
upl-1.0 | universal_permissive_<lic> | opensource\.org/licenses?/upl
vim | vim_<lic> | -
vostrom | vostrom_public_<lic> | -
vsl-1.0 | vovida_software_<lic> | -
w3c | w3c_software_(?:notice_and_)?<lic> | w3\.org/consortium/legal
watcom-1.0 | sybase_open_watcom_public_<lic> | -
wtfpl | do_what_the_f[u*]ck_you_want_to_public_<lic> | wtfpl\.net
x11 | x11_<lic>|mit/x11_<lic> | -
xfree86-1.1 | xfree86_<lic> | xfree86\.org/.{0,40}license
xnet | x\.net(?:,_inc\.)?_<lic> | opensource\.org/licenses?/xnet
zend-2.0 | zend_(?:engine_)?<lic> | -
zimbra-1.3 | zimbra_public_<lic> | -
zlib | zlib(?:/libpng)?_<lic> | opensource\.org/licenses?/zlib|zlib\.net/zlib_license
zpl-2.1 | zope_public_<lic> | opensource\.org/licenses?/zpl-2\.1
"""

#: Notices and texts that name no licence in a regular way: label, priority, then a pattern a line.
NOTICES = r"""
= mit 40
permission_is_hereby_granted,?_free_of_charge,?_to_any_person_obtaining_a_copy
to_use,_copy,_modify,_merge,_publish,_distribute,_sublicense
shall_be_included_in_all_copies_or_substantial_portions_of_the_software
= isc 40
permission_to_use,_copy,_modify,_and(?:/or)?_distribute_this_software_for_any_purpose
= bsd-3-clause 40
neither_the_name_of(?:<long>|_.{1,120}?_)may_be_used_to_endorse_or_promote
= bsd-2-clause 35
redistribution_and_use_in_source_and_binary_forms
redistributions_in_binary_form_must_reproduce_the_above_copyright
redistributions_of_source_code_must_retain_the_above_copyright
= bsd-4-clause 42
all_advertising_materials_mentioning_features
= apache-2.0 40
licensed_under_the_apache_<lic>,?_version_2\.0
distributed_on_an_"?as_is"?_basis,_without_warranties_or_conditions_of_any_kind
licensed_to_the_apache_software_foundation_\(asf\)_under_one_or_more_contributor_license_agreements
= gpl-2.0-or-later 45
version_2_of_the_<lic>,_or_\(?at_your_option\)?_any_later_version
= gpl-3.0-or-later 45
version_3_of_the_<lic>,_or_\(?at_your_option\)?_any_later_version
= gpl 30
you_can_redistribute_it_and/or_modify_it_under_the_terms_of_the_gnu_general_public_<lic>
without_even_the_implied_warranty_of_merchantability_or_fitness_for_a_particular_purpose
gnu_general_public_<lic>
(?<![a-z0-9])gnu_gpl(?![a-z0-9])
= lgpl 30
gnu_lesser_general_public_<lic>
gnu_library_general_public_<lic>
= agpl-3.0 45
remote_network_interaction
= mpl-2.0 45
this_source_code_form_is_subject_to_the_terms_of_the_mozilla_public_<lic>,_v\._2\.0
= epl-2.0 45
this_program_and_the_accompanying_materials_are_made_available_under_the_terms_of_the_eclipse_public_<lic>_v?_?2
= unlicense 45
this_is_free_and_unencumbered_software_released_into_the_public_domain
= zlib 40
provided_'?as-is'?,_without_any_express_or_implied_warranty
= bsl-1.0 40
machine-executable_object_code_generated_by_a_source_language_processor
= wtfpl 40
you_just_do_what_the_f[u*]ck_you_want_to
= public-domain 25
(?:dedicated|released|placed)_(?:in)?to_the_public_domain
(?:is|are)_in_the_public_domain
= proprietary 25
all_rights_reserved
proprietary_and_confidential
unpublished_proprietary_source_code|contains_trade_secrets?
without_(?:the_)?(?:prior_|express_)*written_(?:permission|consent)_of
= copyright 10
copyright_(?:\(c\)|\xc2\xa9|&copy;)?_?(?:19|20)[0-9]{2}
= creative-commons 20
creative_commons(?:_attribution)?(?:-[a-z]+)*_<lic>
creativecommons\.org/(?:licenses|publicdomain)/[a-z0-9./-]*
= generic-license 5
(?:(?:is|are)_?|<lead>)?licensed_under<giving>(?:the_)?(?:terms_of_)?(?:the_)?[a-z0-9.\- ]{2,60}
end[- ]user_<lic>_agreement
see_the_<lic>_for_the_specific_language
= dual-license 15
dual[- ]licensed_under
= eula 20
(?<![a-z])eula(?![a-z])
= no-warranty 8
(?:no|without)_(?:any_)?warrant(?:y|ies)
"as_is"
= patent-grant 12
royalty-free,?_(?:irrevocable,?_)?(?:\(except_as_stated.{0,40}\)_)?patent_<lic>
= gpl-exception 50
classpath_exception
(?:(?:static|gcc_runtime_library|openssl)_?|<lead>)?linking_exception
"""
